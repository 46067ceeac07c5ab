"""Training sets, reports and run artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.operators.select import flatten_report


def write_training(df: DataFrame, path: str) -> None:
    """One folder per dataset, so a reader of one dataset skips the others."""
    df.write.mode("append").partitionBy("dataset").parquet(path)


def extract_training(spark: SparkSession, path: str, dataset: str, schema: str) -> DataFrame:
    """S05."""
    return (spark.read.schema(schema).parquet(path).filter(F.col("dataset") == dataset)
            .select("id", "embedding", "label", "text"))


def write_report_csv(report: DataFrame, path: str, ids=()) -> None:
    """Nested report as ``path_key,value`` lines with a header."""
    flatten_report(report, ids).write.mode("overwrite").option("header", "true").csv(path)


def write_artifacts(path: str, **tables: DataFrame) -> None:
    """Each table as JSON lines and as CSV under its own name."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}.json")
        df.write.mode("overwrite").option("header", "true").csv(f"{path}/{name}.csv")
