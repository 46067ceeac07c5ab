"""Operations and document analytics on Spark DataFrames."""
