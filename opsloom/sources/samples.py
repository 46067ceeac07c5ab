"""Metric sample store: fixed schema, partitioned by collector and date."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.model import METRIC_SAMPLES

STORED = METRIC_SAMPLES + ", date DATE"


def read_samples(spark: SparkSession, path: str, json_labels: bool = False) -> DataFrame:
    """``json_labels`` parses labels kept as JSON text."""
    if not json_labels:
        return spark.read.schema(STORED).parquet(path)
    raw = spark.read.schema(STORED.replace("MAP<STRING,STRING>", "STRING")).parquet(path)
    return raw.withColumn("labels", F.from_json("labels", "map<string,string>"))


def collection_rows(rounds: DataFrame) -> DataFrame:
    """Rounds ``(collector, metrics MAP<name, STRUCT<value, labels, timestamp>>)`` as samples."""
    flat = rounds.select("collector", F.explode("metrics").alias("name", "m"))
    ts = F.col("m.timestamp").cast("timestamp")
    ident = F.xxhash64("collector", "name", "m.timestamp", F.to_json("m.labels"))
    return flat.select(ident.alias("sample_id"), "name", F.col("m.value").cast("double")
                       .alias("value"), F.col("m.labels").alias("labels"), ts.alias("ts"),
                       "collector", ts.cast("date").alias("date"))


def append_samples(rounds: DataFrame, path: str) -> None:
    """Append one or many rounds.

    Range partitioning by (collector, date, name, ts) spreads a busy day over several files and
    sorts every file, so row-group statistics serve name and time filters. A round that is appended
    again adds nothing: samples whose ids the store already has on those days are left out.
    """
    rows = collection_rows(rounds).dropDuplicates(["sample_id"])
    days = rows.agg(F.min("date").alias("low"), F.max("date").alias("high")).first()
    try:
        stored = rows.sparkSession.read.parquet(path)
    except AnalysisException:   # no store yet
        stored = None
    if stored is not None and days["low"] is not None:
        known = stored.filter(F.col("date").between(days["low"], days["high"])).select("sample_id")
        rows = rows.join(known, "sample_id", "left_anti").select(*rows.columns)
    (rows.repartitionByRange("collector", "date", "name", "ts")
     .sortWithinPartitions("collector", "date", "name", "ts")
     .write.mode("append").partitionBy("collector", "date").parquet(path))
