"""Lookups between files, tags, caches and points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.operators.ordered import MICROS
from opsloom.session import small_table

# Class number ranges and their categories.
DEWEY_RANGES = [
    (0, 99, "Computer science, information & general works"),
    (100, 199, "Philosophy & psychology"),
    (200, 299, "Religion"),
    (300, 399, "Social sciences"),
    (400, 499, "Language"),
    (500, 599, "Science"),
    (600, 699, "Technology"),
    (700, 799, "Arts & recreation"),
    (800, 899, "Literature"),
    (900, 999, "History & geography"),
]


def dewey_ranges(spark) -> DataFrame:
    return small_table(spark, "pos INT, start INT, end INT, category STRING",
                       [(i, *r) for i, r in enumerate(DEWEY_RANGES)])


def join_sidecars(files: DataFrame, side: DataFrame) -> DataFrame:
    """File with the metadata of its sidecar, matched on path."""
    return files.join(side.withColumnRenamed("path", "file_path"), "file_path", "left")


def dewey_category(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Category of the first range that holds the class number; '' when none does.

    Ranges become whole class numbers (at most 1000 each), so this is an equi-join.
    """
    classes = (ranges.withColumn("_class", F.explode(F.sequence("start", "end")))
               .groupBy("_class").agg(F.min_by("category", "pos").alias("dewey_category")))
    number = F.split_part("dewey_decimal", F.lit("."), F.lit(1)).try_cast("int")
    return (files.withColumn("_class", number).join(classes, "_class", "left")
            .withColumn("dewey_category", F.coalesce("dewey_category", F.lit(""))).drop("_class"))


def cache_lookup(todo: DataFrame, cache: DataFrame, now, ttl_s: int = 3600) -> DataFrame:
    """``hit`` tells whether (model, md5_hash) has an entry younger than the TTL."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("written_at")
    alive = (cache.filter(age < ttl_s * MICROS).groupBy("model", "md5_hash")
             .agg(F.max_by("value", "written_at").alias("value")).withColumn("hit", F.lit(True)))
    return todo.join(alive, ["model", "md5_hash"], "left").withColumn(
        "hit", F.coalesce("hit", F.lit(False)))


def insert_absent(new: DataFrame, existing: DataFrame, keys: Sequence[str],
                  first: str) -> DataFrame:
    """Existing rows plus the first new row of every key that is not there yet."""
    cols = existing.columns
    body = F.struct(*[c for c in cols if c not in keys])
    fresh = (new.join(existing.select(*keys), list(keys), "left_anti")
             .groupBy(*keys).agg(F.min_by(body, first).alias("_r"))
             .select(*keys, "_r.*").select(*cols))
    return existing.unionByName(fresh)


def tag_key(name: str = "name", category: str = "category"):
    """Repeatable id from the unique key; no global numbering is needed."""
    return F.md5(F.concat_ws("\u0001", name, category))


def tag_ids(names: DataFrame, tags: DataFrame) -> DataFrame:
    """Get or create the id of every (name, category)."""
    known = tags.select("tag_id", "name", "category")
    wanted = names.select("name", "category").distinct()
    created = wanted.join(known, ["name", "category"], "left_anti").select(
        tag_key().alias("tag_id"), "name", "category")
    return known.unionByName(created)


def processing_times(points: DataFrame) -> DataFrame:
    """Started with its completed or error point; milliseconds, or open."""
    def at(status):
        return F.min(F.when(F.col("status") == status, F.col("us")))

    out = points.groupBy("file_id").agg(at("started").alias("_s"), at("completed").alias("_c"),
                                        at("error").alias("_e"))
    end = F.coalesce("_c", "_e")
    return out.filter("_s IS NOT NULL").select(
        "file_id", ((end - F.col("_s")) / 1000).alias("processing_time_ms"),
        F.when(F.col("_c").isNotNull(), "completed").when(F.col("_e").isNotNull(), "error")
        .otherwise("open").alias("state"))


def files_with_tags(files: DataFrame, file_tags: DataFrame, tags: DataFrame, names: Sequence[str],
                    min_confidence: float = 0.0) -> DataFrame:
    """Files carrying one of the tags with enough confidence (semi-join, no duplicates)."""
    wanted = tags.filter(F.col("name").isin(list(names))).select("tag_id")
    hits = file_tags.filter(F.col("confidence") >= min_confidence).join(wanted, "tag_id").select(
        "file_id")
    return files.join(hits, "file_id", "left_semi")


def only_new(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Files whose content hash has not been processed."""
    return files.join(processed.select("md5_hash"), "md5_hash", "left_anti")


def retry_plan(queue: DataFrame) -> DataFrame:
    """Failed items go back to the queue or, after the last attempt, to failed_jobs."""
    return (queue.filter("status = 'failed'")
            .withColumn("plan", F.when(F.coalesce(F.col("attempts"), F.lit(0))
                                       < F.col("max_attempts"), "retry").otherwise("failed_jobs")))
