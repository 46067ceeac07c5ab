"""A training corpus in five stages: each takes documents and gives documents, the last one their mixture.

Stages keep to their own decision: toxic documents go, one document of each near-duplicate group stays, documents
holding benchmark items go, secrets are masked, and sources are repeated to their target shares.

Results for odd input: rows without an id pass the stages that decide by id; null and empty texts have no words, secrets
or items and stay until the mixture, where they count as any row of their source. Of rows that share an id the
near-duplicate stage keeps one, that of the least text hash, so that a repeated task keeps the same one; equal rows are one
row there. Texts of any length are read whole. An empty table gives an empty result of the same columns, and extra
columns travel along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsloom.llm import decontamination, minhash, mixing, secret_scan, toxicity
from opsloom.session import cut, prepare

PLACE = "place among rows of one id"     # a column for a moment, named as no table names one


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones, does not call toxic."""
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, one row of each document."""
    kept = minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id")
    # the limit of a row an id is applied before the shuffle, so an id with many rows sends few
    whole = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), whole)
    named = (docs.join(kept, "doc_id", "left_semi").withColumn(PLACE, F.row_number().over(order))
             .where(F.col(PLACE) == 1).select(*docs.columns))
    return named.unionByName(docs.where("doc_id IS NULL"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target shares of their sources, shuffled."""
    return mixing.mix_sources(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_leaks),
          ("secrets", mask_secrets), ("mixing", mix)]

# Models and similarity joins can't be said in SQL; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's result written before the next reads it."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
