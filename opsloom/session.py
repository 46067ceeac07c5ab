"""Session defaults and the shared folder for cut lineage and stream state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings every job relies on; safe to apply to a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows that hold whole blocks or vectors go to Python a few at a time, not ten thousand.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def build_session(app: str = "opsloom", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session someone else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own; on a cluster a
    machine-local folder would lose data together with the executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="opsloom-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, kind: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a durable lineage cut."""
    spark = df.sparkSession
    path = fresh_dir(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Spread a table of few input splits over all cores before heavy work per row.

    A table with at least one split per core is returned as it is, so a large scan never shuffles
    here. ``scan`` must be a plain scan: its split count is then known without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, *keys)


def small_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A literal table for rules, routes and lexicons; its size is visible to the planner."""
    fields = spark.createDataFrame([], schema).schema.fields

    def literal(value, dtype) -> Column:
        if isinstance(value, (list, tuple)):
            if not value:
                return F.array().cast(dtype)
            return F.array(*[literal(v, dtype.elementType) for v in value]).cast(dtype)
        if isinstance(value, dict):
            return F.struct(*[literal(value.get(f.name), f.dataType).alias(f.name)
                              for f in dtype.fields]).cast(dtype)
        return F.lit(value).cast(dtype)

    structs = [F.struct(*[literal(v, f.dataType).alias(f.name) for v, f in zip(row, fields)])
               for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
