"""Versioned snapshots of state tables.

Versions are immutable folders ``<root>/<kind>/<stamp>``; a catalogue row is appended once the
version is complete, so a lost job leaves at most an unlisted folder.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.operators.state import rotation

CATALOGUE = "kind STRING, stamp STRING, taken_at TIMESTAMP, path STRING, row_count LONG, bytes LONG"
# How many snapshots of each kind rotation keeps.
KEEP = {"daily": 7, "weekly": 4, "monthly": 12}


def _folder_bytes(spark: SparkSession, path: str) -> int:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def snapshot(df: DataFrame, root: str, kind: str, now) -> str:
    """Write a version and list it; returns its stamp."""
    spark = df.sparkSession
    taken = F.lit(now).cast("timestamp")
    stamp = spark.range(1).select(F.date_format(taken, "yyyyMMdd_HHmmss")).first()[0]
    path = f"{root}/{kind}/{stamp}"
    df.write.mode("errorifexists").parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).count()
    entry = spark.range(1).select(
        F.lit(kind).alias("kind"), F.lit(stamp).alias("stamp"), taken.alias("taken_at"),
        F.lit(path).alias("path"), F.lit(rows).cast("long").alias("row_count"),
        F.lit(_folder_bytes(spark, path)).cast("long").alias("bytes"))
    entry.coalesce(1).write.mode("append").parquet(f"{root}/_catalogue")
    return stamp


def list_snapshots(spark: SparkSession, root: str, kind: str | None = None) -> DataFrame:
    """Newest first."""
    rows = spark.read.schema(CATALOGUE).parquet(f"{root}/_catalogue")
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    return rows.orderBy(F.desc("taken_at"))


def expired(spark: SparkSession, root: str, keep: Mapping[str, int] | None = None) -> DataFrame:
    """Versions that rotation no longer keeps."""
    return rotation(list_snapshots(spark, root), dict(keep or KEEP)).filter("NOT keep")


def verify_snapshot(spark: SparkSession, root: str, kind: str, stamp: str, schema) -> DataFrame:
    """Q06: listed, readable, required columns present, row count as listed."""
    listed = list_snapshots(spark, root, kind).filter(F.col("stamp") == stamp).first()
    checks = [("listed", listed is not None)]
    if listed is not None:
        try:
            found = spark.read.parquet(listed["path"])
            have = {(f.name, f.dataType) for f in found.schema.fields}
            checks += [("readable", True),
                       ("schema", all((f.name, f.dataType) in have for f in schema.fields)),
                       ("rows", found.count() == listed["row_count"])]
        except AnalysisException:  # missing or without a readable schema: a finding
            checks.append(("readable", False))
    cells = [F.struct(F.lit(n).alias("check"), F.lit(bool(ok)).alias("ok")) for n, ok in checks]
    return spark.range(1).select(F.inline(F.array(*cells)))


def restore(spark: SparkSession, root: str, kind: str, stamp: str, current: DataFrame, target: str,
            now) -> DataFrame:
    """Check the version, keep the current table as a snapshot, write a new table version."""
    failed = verify_snapshot(spark, root, kind, stamp, current.schema).filter("NOT ok").count()
    if failed:
        raise ValueError(f"snapshot {kind}/{stamp} failed {failed} checks")
    snapshot(current, root, "pre_restore", now)
    version = spark.read.schema(current.schema).parquet(f"{root}/{kind}/{stamp}")
    path = f"{target}/restored-{stamp}"
    version.write.mode("errorifexists").parquet(path)
    return spark.read.schema(current.schema).parquet(path)
