"""Listings, upsert, retention, snapshots of state tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.operators.ordered import keep_newest


def newest(df: DataFrame, n: int, order: Sequence[str] = ("ts", "sample_id")) -> DataFrame:
    """A top-n, so each task sends at most ``n`` rows."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def priority_code(priority):
    return F.when(priority == "high", 0).when(priority == "medium", 1).otherwise(2)


def next_items(items: DataFrame, k: int, per: Sequence[str] = ()) -> DataFrame:
    """Pending items by priority, oldest first; ``per`` gives ``k`` to each worker."""
    pending = items.filter("status = 'pending'").withColumn(
        "_p", priority_code(F.col("priority")))
    if not per:
        return pending.orderBy("_p", "created_at", "id").limit(k).drop("_p")
    # Most urgent first == largest negated key first.
    keyed = (pending.withColumn("_np", -F.col("_p"))
             .withColumn("_nc", -F.unix_micros(F.col("created_at").cast("timestamp")))
             .withColumn("_ni", -F.col("id")))
    return keep_newest(keyed, per, ["_np", "_nc", "_ni"], k, spread="id").drop(
        "_p", "_np", "_nc", "_ni")


def dedup_exact(files: DataFrame, key: str = "md5_hash", first: str = "file_id") -> DataFrame:
    """Keep the first row of each hash. ``min_by`` combines before the shuffle."""
    cols = [c for c in files.columns if c not in (key, first)]
    packed = F.struct(first, *cols)
    return (files.groupBy(key).agg(F.min_by(packed, first).alias("_r"))
            .select(key, "_r.*").select(*files.columns))


def duplicate_counts(files: DataFrame, key: str = "md5_hash") -> DataFrame:
    return files.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def all_history(**by_type: DataFrame) -> DataFrame:
    """Histories of every handler, tagged by type."""
    out = None
    for kind, df in by_type.items():
        tagged = df.withColumn("handler", F.lit(kind))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def missing(required: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Required minus present."""
    return required.select(*on).distinct().join(present.select(*on), list(on), "left_anti")


def upsert(state: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Latest row per key wins, first ``created_at`` stays, a latest delete removes the key.

    Both frames carry ``created_at``, ``updated_at``, ``seq`` (tie-break) and ``deleted``.
    After a delete a later save starts with its own ``created_at``.
    """
    both = state.unionByName(changes)
    rank = F.struct("updated_at", "seq")
    body = [c for c in both.columns if c not in (key, "created_at")]
    last_delete = F.max(F.when(F.col("deleted"), rank))
    dropped = both.groupBy(key).agg(last_delete.alias("_gone")).filter("_gone IS NOT NULL")
    alive = (both.join(dropped, key, "left")
             .filter(F.col("_gone").isNull() | (F.struct("updated_at", "seq") > F.col("_gone"))))
    return (alive.groupBy(key)
            .agg(F.max_by(F.struct(*body), rank).alias("_b"),
                 F.min("created_at").alias("created_at"))
            .select(key, "created_at", *[F.col("_b")[c].alias(c) for c in body]))


def retain(df: DataFrame, days: int, now, ts: str = "ts") -> DataFrame:
    """Rows not older than the cutoff (a row exactly at the cutoff stays)."""
    return df.filter(F.col(ts) >= _cutoff(days, now))


def retention_count(df: DataFrame, days: int, now, ts: str = "ts",
                    by: Sequence[str] = ()) -> DataFrame:
    """How many rows retention keeps and drops."""
    old = F.col(ts) < _cutoff(days, now)
    return df.groupBy(*by).agg(F.count_if(old).alias("dropped"), F.count_if(~old).alias("kept"))


def _cutoff(days: int, now):
    return F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")


def live_cache(cache: DataFrame, now, pattern: str | None = None) -> DataFrame:
    """Entries that have not expired, optionally keys LIKE ``pattern``."""
    lives = F.unix_micros("written_at") + F.col("ttl_s").cast("long") * 1_000_000
    out = cache.filter(lives > F.unix_micros(F.lit(now).cast("timestamp")))
    return out.filter(F.col("key").like(pattern)) if pattern else out


def last_values(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str], n: int,
                spread: str) -> DataFrame:
    """W10 as an array: the newest ``n`` values per group in time order."""
    kept = keep_newest(df, by, order, n, spread)
    return kept.groupBy(*by).agg(F.transform(
        F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v")))),
        lambda s: s["_v"]).alias("matched_values"))


def rotation(catalogue: DataFrame, keep: dict[str, int]) -> DataFrame:
    """W10 for snapshots: age rank per kind and whether rotation keeps it (fixed small counts)."""
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in keep.items()], F.lit(0))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("taken_at")))
    return catalogue.withColumn("age_rank", rank).withColumn("keep", F.col("age_rank") <= limit)
