"""Summaries, health, trends and reports over metric samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.operators.ordered import HOUR, MICROS, by_time, null_safe
from opsloom.operators.select import pct

TREND_LIMIT = 0.1


def window_start(us: str | Column, seconds: int) -> Column:
    return by_time(us, seconds)


def trend_class(n: Column, slope: Column) -> Column:
    """Fewer than two samples or a small slope is stable."""
    return (F.when((n < 2) | slope.isNull() | (F.abs(slope) < TREND_LIMIT), "stable")
            .when(slope > 0, "increasing").otherwise("decreasing"))


def series_summary(df: DataFrame, keys: Sequence[str], value: str = "value", us: str = "us",
                   tie: str = "sample_id", seconds: int = HOUR,
                   as_coded: bool = False, total: str | None = None) -> DataFrame:
    """n, current, avg, max and least-squares slope on the sample index, per ``keys``.

    ``total`` names a further column for the sum of the values.

    A series is summarised slice by slice and the slices are merged with the pairwise covariance
    formula, so no task holds a whole series and the index offsets never travel back to the rows.
    ``as_coded`` reads samples newest first, as the reference does: current is the oldest sample
    and the slope changes sign.
    """
    sliced = df.filter(F.col(value).isNotNull()).withColumn("_slice", by_time(us, seconds))
    position = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(us, tie)) - 1
    per_slice = (sliced.withColumn("_i", position).groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_mv"),
        (F.covar_pop("_i", value) * F.count(F.lit(1))).alias("_c"), F.max(value).alias("_hi"),
        F.max_by(value, "_i").alias("_last"), F.min_by(value, "_i").alias("_first"),
        F.sum(value).alias("_sum")))
    across = Window.partitionBy(*keys)
    before = across.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_slice.withColumns({
        "_mi": F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") - 1) / 2,
        "_all_n": F.sum("_n").over(across),
        "_all_mean": F.sum(F.col("_n") * F.col("_mv")).over(across) / F.sum("_n").over(across)})
    cross = F.col("_c") + F.col("_n") * (F.col("_mi") - (F.col("_all_n") - 1) / 2) * (
        F.col("_mv") - F.col("_all_mean"))
    n = F.sum("_n").cast("double")
    slope = F.when(F.sum("_n") >= 2, F.sum(cross) / (n * (n * n - 1) / 12))
    current = F.min_by("_first", "_slice") if as_coded else F.max_by("_last", "_slice")
    out = placed.groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        F.coalesce(current, F.lit(0.0)).alias("current"),
        F.coalesce(F.sum(F.col("_n") * F.col("_mv")) / n, F.lit(0.0)).alias("avg"),
        F.coalesce(F.max("_hi"), F.lit(0.0)).alias("max"),
        (-slope if as_coded else slope).alias("slope"),
        *([F.sum("_sum").alias(total)] if total else []))
    return out.withColumn("trend", trend_class(F.col("n"), F.col("slope")))


def metric_summary(df: DataFrame, keys: Sequence[str] = ("collector", "name")) -> DataFrame:
    """A01."""
    return df.groupBy(*keys).agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.avg("value").alias("avg_value"),
        F.max_by("value", F.struct("us", "sample_id")).alias("last_value"),
        F.max("us").alias("last_update"))


def ewma_half(df: DataFrame, keys: Sequence[str] = ("name",), seconds: int = HOUR) -> DataFrame:
    """``avg = (avg + value) / 2`` in time order, starting from the first value.

    Each slice is folded to its count and ``sum(value * 2^-rank)``, newest first; a slice then
    weighs 2^-(samples after it). The first sample of a series has the weight of its successor.
    Every sample takes part, so an early Inf or NaN stays in the average as in the recursion.
    """
    safe, names = null_safe(df, keys)
    sliced = safe.withColumn("_slice", by_time("us", seconds))
    newest = Window.partitionBy(*names, "_slice").orderBy(F.desc("us"), F.desc("sample_id"))
    rank = F.row_number().over(newest)
    order = F.struct("us", "sample_id")
    per_slice = sliced.withColumn("_r", rank).groupBy(*keys, *[n for n in names if n not in keys],
                                                      "_slice").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("value") * half_to(F.col("_r"))).alias("_s"),
        F.min_by("value", order).alias("_first"))
    across = Window.partitionBy(*names).orderBy(F.desc("_slice"))
    after = F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = per_slice.withColumns({"_after": after, "_oldest": F.lead("_slice").over(across).isNull()})
    first = F.when(F.col("_oldest"), F.col("_first") * half_to(F.col("_after") + F.col("_n")))
    return placed.groupBy(*keys).agg(
        (F.sum(F.col("_s") * half_to(F.col("_after"))) + F.sum(first)).alias("ewma_half"))


def half_to(n: Column) -> Column:
    """2^-n, not below the smallest double that keeps Inf and NaN what they are."""
    return F.pow(F.lit(0.5), F.least(n, F.lit(1074)).cast("double"))


def health(df: DataFrame, name: str, end=None, window_s: int = 300) -> DataFrame:
    """One row for one metric in the look-back window; zeros and stable when empty."""
    rows = df.filter(F.col("name") == name)
    if end is not None:
        stop = F.lit(end).cast("timestamp")
        rows = rows.filter((F.col("ts") <= stop)
                           & (F.col("ts") >= stop - F.expr(f"INTERVAL {int(window_s)} SECONDS")))
    return series_summary(rows, [])


def latest(df: DataFrame, by: Sequence[str], cols: Sequence[str] = ("value", "us"),
           order: Sequence[str] = ("us", "sample_id")) -> DataFrame:
    """W01."""
    return (df.groupBy(*by).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_l"))
            .select(*by, "_l.*"))


def error_stats(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Current, total and trend per error type; a NULL type is a type of its own."""
    return series_summary(df, by, total="total")


RANGES = {"1h": 1, "6h": 6, "24h": 24, "7d": 168}


def range_summary(df: DataFrame, now, ranges: Sequence[str] = tuple(RANGES),
                  by: Sequence[str] = ("collector",)) -> DataFrame:
    """A10: averages and counts over several look-back ranges in one pass."""
    unknown = [r for r in ranges if r not in RANGES]
    if unknown:
        raise ValueError(f"invalid time range {unknown}")
    stop = F.lit(now).cast("timestamp")
    start = {r: stop - F.expr(f"INTERVAL {RANGES[r]} HOURS") for r in ranges}
    longest = max(ranges, key=RANGES.get)
    recent = df.filter((F.col("ts") >= start[longest]) & (F.col("ts") <= stop))
    aggs = []
    for r in ranges:
        inside = F.col("ts") >= start[r]
        aggs += [F.count_if(inside).alias(f"n_{r}"),
                 F.avg(F.when(inside, F.col("value"))).alias(f"avg_{r}")]
    return recent.groupBy(*by).agg(*aggs)


def queue_wait(items: DataFrame, now, by: Sequence[str] = ("processor", "priority")) -> DataFrame:
    """Size, mean wait in seconds, 60 / mean wait (0 when there is no wait)."""
    stop = F.unix_micros(F.lit(now).cast("timestamp"))
    wait = (stop - F.unix_micros(F.col("created_at").cast("timestamp"))) / MICROS
    out = items.filter("status = 'pending'").groupBy(*by).agg(
        F.count(F.lit(1)).alias("queue_size"), F.avg(wait).alias("wait_time"))
    return out.withColumn("processing_rate", F.when(F.col("wait_time") > 0,
                                                    60 / F.col("wait_time")).otherwise(F.lit(0.0)))


def error_metrics(stats: DataFrame, ids: Sequence[str] = ("snapshot",)) -> DataFrame:
    """Nested error snapshot -> (metric, processor, error_type, value) rows."""
    none = F.lit(None).cast("string")

    def rows(df, metric, processor, error_type, value):
        return df.select(*ids, F.lit(metric).alias("metric"), processor.alias("processor"),
                         error_type.alias("error_type"), value.cast("double").alias("value"))

    overall = rows(stats, "pipeline_error_rate", none, none,
                   pct(F.col("total_errors"), F.col("total_operations")))
    by_type = stats.select(*ids, F.explode("error_types").alias("t", "n"))
    per_proc = stats.select(*ids, F.explode("processor_errors").alias("p", "s"))
    per_proc_type = per_proc.select(*ids, "p", F.explode("s.error_types").alias("t", "n"))
    return (overall
            .unionByName(rows(by_type, "error_count", none, F.col("t"), F.col("n")))
            .unionByName(rows(per_proc, "processor_error_rate", F.col("p"), none,
                              pct(F.col("s.errors"), F.col("s.operations"))))
            .unionByName(rows(per_proc_type, "processor_error_count", F.col("p"), F.col("t"),
                              F.col("n"))))


def performance_snapshot_metrics(stats: DataFrame, ids: Sequence[str] = ("snapshot",)) -> DataFrame:
    """A16 from a nested snapshot; absent numbers count as 0."""
    none = F.lit(None).cast("string")

    def rows(df, pairs, processor=none, file_type=none):
        cells = [F.struct(F.lit(m).alias("metric"),
                          F.coalesce(v.cast("double"), F.lit(0.0)).alias("value"))
                 for m, v in pairs]
        return (df.withColumns({"_p": processor, "_f": file_type})
                .select(*ids, F.col("_p").alias("processor"), F.col("_f").alias("file_type"),
                        F.inline(F.array(*cells))))

    c = F.col
    overall = rows(stats, [("avg_processing_time", c("average_processing_time")),
                           ("max_processing_time", c("max_processing_time")),
                           ("min_processing_time", c("min_processing_time")),
                           ("pipeline_cpu_usage", c("resource_utilization.cpu_usage")),
                           ("pipeline_memory_usage", c("resource_utilization.memory_usage")),
                           ("pipeline_disk_io", c("resource_utilization.disk_io"))])
    procs = stats.select(*ids, F.explode("processors").alias("p", "s"))
    per_proc = rows(procs, [("processor_avg_time", c("s.average_time")),
                            ("processor_max_time", c("s.max_time")),
                            ("processor_min_time", c("s.min_time"))], c("p"))
    types = procs.select(*ids, "p", F.explode("s.file_types").alias("f", "t"))
    per_type = rows(types, [("processor_avg_time", c("t.average_time"))], c("p"), c("f"))
    return overall.unionByName(per_proc).unionByName(per_type)


def performance_metrics(df: DataFrame, processor: str, file_type: str, value: str) -> DataFrame:
    """A16 from raw rows: overall, per processor and per processor and file type in one pass."""
    return (df.groupingSets([[], [processor], [processor, file_type]], processor, file_type)
            .agg(F.avg(value).alias("avg_time"), F.max(value).alias("max_time"),
                 F.min(value).alias("min_time"), F.count(F.lit(1)).alias("n"),
                 F.grouping_id().alias("level")))


def queue_status(files: DataFrame, queue: Column) -> DataFrame:
    """Sidecars count neither as files nor as bytes; a third column includes them."""
    sidecar = F.col("file_name").endswith(".metadata")
    return files.groupBy(queue.alias("queue")).agg(
        F.count_if(~sidecar).alias("files"),
        F.sum(F.when(~sidecar, F.col("file_size")).otherwise(0)).alias("bytes"),
        F.sum("file_size").alias("bytes_with_sidecars"))


def health_rollup(checks: DataFrame, by: Sequence[str]) -> DataFrame:
    """All up -> PASS, some up -> WARN, none up -> FAIL."""
    out = checks.groupBy(*by).agg(F.count(F.lit(1)).alias("total"),
                                  F.count_if(F.col("up")).alias("up"))
    return out.withColumn("status", F.when(F.col("up") == F.col("total"), "PASS")
                          .when(F.col("up") > 0, "WARN").otherwise("FAIL"))


def collector_status(df: DataFrame, approximate: bool = False) -> DataFrame:
    """A26."""
    names = F.approx_count_distinct("name") if approximate else F.count_distinct("name")
    return df.groupBy("collector").agg(F.max("us").alias("last_collection"),
                                       names.alias("metrics_count"))


def throughput(df: DataFrame, every_s: int, by: Sequence[str]) -> DataFrame:
    """Items per second per group and interval."""
    return (df.groupBy(*by, window_start("us", every_s).alias("window_us"))
            .agg((F.count(F.lit(1)) / every_s).alias("per_second")))


def pool_vectors(chunks: DataFrame, key: str = "file_id", vec: str = "embedding") -> DataFrame:
    """Mean of chunk vectors, then L2 norm 1; a zero mean vector gives NULL."""
    whole = chunks.filter(F.col(vec).isNotNull()).select(
        key, array_to_vector(F.col(vec).cast("array<double>")).alias("_x"))
    packed = whole.groupBy(key).agg(Summarizer.mean(F.col("_x")).alias("_m")).select(
        key, vector_to_array("_m").alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    return (packed.withColumn("_n", norm)
            .select(key, F.when(F.col("_n") > 0, F.transform("_v", lambda x: x / F.col("_n")))
                    .alias("embedding")))


def api_metrics(points: DataFrame, tags: Sequence[str] = ("endpoint", "model", "status")) -> DataFrame:
    """A29."""
    return points.groupBy(*tags).agg(
        F.count(F.lit(1)).alias("calls"), F.avg("response_time_ms").alias("avg_ms"),
        F.percentile_approx("response_time_ms", 0.95, 10000).alias("p95_ms"),
        F.sum("tokens").alias("tokens"), F.sum("error_count").alias("errors"))


def system_points(points: DataFrame, tags: Sequence[str] = ("service", "host")) -> DataFrame:
    """A30."""
    return points.groupBy(*tags).agg(*[F.avg(c).alias(f"avg_{c}") for c in (
        "cpu_usage", "memory_usage", "disk_usage")], F.max("queue_size").alias("max_queue_size"))


def rate_limit_audit(log: DataFrame, average: int = 100, burst: int = 50,
                     period_s: int = 1) -> DataFrame:
    """Client periods with more than ``average * period + burst`` requests."""
    counts = log.groupBy("client", window_start("us", period_s).alias("window_us")).agg(
        F.count(F.lit(1)).alias("requests"))
    limit = average * period_s + burst
    return counts.filter(F.col("requests") > limit).withColumn("excess", F.col("requests") - limit)


def reduce_series(df: DataFrame, by: Sequence[str], calcs: Sequence[str]) -> DataFrame:
    """Legend reducers."""
    order = F.when(F.col("value").isNotNull(), F.struct("us", "sample_id"))
    makers: Mapping[str, Column] = {
        "mean": F.avg("value"), "max": F.max("value"), "min": F.min("value"),
        "lastNotNull": F.max_by("value", order)}
    return df.groupBy(*by).agg(*[makers[c].alias(c) for c in calcs])
