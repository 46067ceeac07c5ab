"""Counter rates, histograms, quantiles and panel queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.operators.ordered import by_time, previous, trailing_sum
from opsloom.operators.summary import window_start

INF = "+Inf"


def counter_deltas(df: DataFrame, by: Sequence[str], counter: str = "counter", us: str = "us",
                   tie: str = "sample_id") -> DataFrame:
    """Increase since the previous sample; a smaller value is a restart from zero."""
    prev = previous(df, by, [us, tie], {"_prev": F.col(counter)}, by_time(us))
    v, p = F.col(counter), F.col("_prev")
    delta = F.when(p.isNull(), F.lit(0.0)).when(v < p, v).otherwise(v - p)
    return prev.withColumn("delta", delta).drop("_prev")


def counter_rate(df: DataFrame, by: Sequence[str], window_s: int = 300,
                 counter: str = "counter") -> DataFrame:
    """Per-second rate over ``(t - window, t]`` at every sample; no edge extrapolation."""
    summed = trailing_sum(counter_deltas(df, by, counter), by, "us",
                          {"increase": F.col("delta")}, window_s, inclusive=False)
    return summed.withColumn("rate", F.col("increase") / window_s)


def step_rates(df: DataFrame, by: Sequence[str], step_s: int, counter: str = "counter") -> DataFrame:
    """Rate per series and step: the range equals the step, so deltas add up before the shuffle."""
    return (counter_deltas(df, by, counter)
            .groupBy(*by, window_start("us", step_s).alias("step_us"))
            .agg((F.sum("delta") / step_s).alias("rate")))


def sum_by(df: DataFrame, by: Sequence[str], value: str = "rate") -> DataFrame:
    """A14."""
    return df.groupBy(*by).agg(F.sum(value).alias(value))


def error_share(rates: DataFrame, failure: Column, success: Column, labels: Sequence[str],
                by: Sequence[str] = ()) -> DataFrame:
    """``sum(failure) / sum(success + failure)`` per step, from rows that are one, the other or neither.

    The denominator matches the two sides on their labels, so a series that lacks either side
    counts in the numerator only. NULL labels match each other. A step without any match has no row.
    """
    keys, rate = [*labels, "step_us"], F.col("rate")
    sides = rates.filter(failure | success).groupBy(*keys).agg(
        F.sum(F.when(failure, rate)).alias("_f"), F.sum(F.when(success, rate)).alias("_s"),
        F.max(failure & rate.isNotNull()).alias("_has_f"), F.max(success & rate.isNotNull()).alias("_has_s"))
    both = F.col("_has_f") & F.col("_has_s")
    group = [*by, "step_us"]
    return (sides.groupBy(*group).agg(
        F.sum("_f").alias("_f"), F.sum(F.when(both, F.col("_f") + F.col("_s"))).alias("_t"), F.max(both).alias("_m"))
        .filter("_m").select(*group, F.try_divide("_f", "_t").alias("error_ratio")))


def error_ratio(failures: DataFrame, successes: DataFrame, labels: Sequence[str],
                by: Sequence[str] = ()) -> DataFrame:
    """J11 for two tables of rates."""
    cols = [*labels, "step_us", "rate"]
    rates = failures.select(*cols, F.lit(True).alias("_side")).unionByName(
        successes.select(*cols, F.lit(False).alias("_side")))
    return error_share(rates, F.col("_side"), ~F.col("_side"), labels, by)


def bound_label(bound: float) -> str:
    return f"{bound:g}"


def histogram(df: DataFrame, buckets: Sequence[float], by: Sequence[str],
              value: str = "value") -> DataFrame:
    """Cumulative ``le`` buckets with +Inf, plus sum and count, per label set."""
    agg = df.groupBy(*by).agg(
        *[F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(buckets)],
        F.count(value).alias("count"), F.sum(value).alias("sum"))
    cells = [F.struct(F.lit(bound_label(b)).alias("le"), F.col(f"_b{i}").alias("cum_count"))
             for i, b in enumerate(buckets)]
    cells.append(F.struct(F.lit(INF).alias("le"), F.col("count").alias("cum_count")))
    return agg.select(*by, "count", "sum", F.inline(F.array(*cells)))


def le_value(le: str = "le") -> Column:
    return F.when(F.col(le) == INF, F.lit(float("inf"))).otherwise(F.col(le).cast("double"))


def histogram_quantile(h: DataFrame, q: float, by: Sequence[str]) -> DataFrame:
    """Linear interpolation inside the first bucket that reaches ``q * total``.

    A hit in +Inf gives the largest finite bound; an empty histogram gives NULL. Each group holds
    one row per bucket, so its window stays small.
    """
    group = Window.partitionBy(*by)
    ordered = group.orderBy("_le")
    rows = h.withColumn("_le", le_value()).withColumns({
        "_low": F.lag("_le").over(ordered), "_before": F.lag("cum_count").over(ordered),
        "_want": F.lit(q) * F.max("cum_count").over(group)})
    low = F.coalesce(F.col("_low"), F.least(F.lit(0.0), F.col("_le")))
    before = F.coalesce(F.col("_before"), F.lit(0))
    inside = low + (F.col("_le") - low) * F.try_divide(F.col("_want") - before,
                                                       F.col("cum_count") - before)
    value = F.when(F.col("_want") == 0, F.lit(None)).when(F.col("le") == INF, F.col("_low")
                                                          ).otherwise(inside)
    return (rows.filter(F.col("cum_count") >= F.col("_want"))
            .groupBy(*by).agg(F.min_by(F.struct(value.alias("v")), "_le").alias("_q"))
            .select(*by, F.lit(q).alias("q"), F.col("_q.v").alias("quantile")))


PANEL_FUNCTIONS = {"max": F.max, "mean": F.avg, "min": F.min, "sum": F.sum, "count": F.count}


def panel(df: DataFrame, target: Mapping, start=None, end=None,
          step_s: int | None = None) -> DataFrame:
    """``target`` holds metric, aggregation (max, mean, ..., histogram), groupBy, buckets."""
    rows = df.filter(F.col("name") == target["metric"])
    if start is not None:
        rows = rows.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    by = list(target.get("groupBy", ()))
    rows = rows.withColumns({k: F.col("labels")[k] for k in by if k not in df.columns})
    if step_s:
        rows = rows.withColumn("step_us", window_start("us", step_s))
        by = ["step_us", *by]
    if target["aggregation"] == "histogram":
        return histogram(rows, target["buckets"], by)
    return rows.groupBy(*by).agg(
        PANEL_FUNCTIONS[target["aggregation"]]("value").alias("value"))


def heatmap(df: DataFrame, step_s: int, buckets: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Counts per time step and value bucket (upper bounds, last one +Inf)."""
    label = F.lit(INF)
    for b in sorted(buckets, reverse=True):
        label = F.when(F.col("value") <= b, bound_label(b)).otherwise(label)
    return (df.filter(F.col("value").isNotNull())
            .groupBy(*by, window_start("us", step_s).alias("step_us"), label.alias("le"))
            .agg(F.count(F.lit(1)).alias("n")))


def exposition(df: DataFrame, defs: Sequence[Mapping], by: Sequence[str]) -> DataFrame:
    """One row per exposed number; gauges show the latest, counters the total."""
    out = None

    def rows(src, metric, kind, value, le=None):
        return src.select(F.lit(metric).alias("metric"), F.lit(kind).alias("type"), *by,
                          (F.col(le) if le else F.lit(None).cast("string")).alias("le"),
                          F.col(value).cast("double").alias("value"))

    for d in defs:
        mine = df.filter(F.col("name") == d["name"])
        if d["type"] == "gauge":
            last = mine.groupBy(*by).agg(
                F.max_by("value", F.struct("us", "sample_id")).alias("v"))
            parts = [rows(last, d["name"], "gauge", "v")]
        elif d["type"] == "counter":
            total = mine.groupBy(*by).agg(F.sum("value").alias("v"))
            parts = [rows(total, d["name"], "counter", "v")]
        elif d["type"] == "histogram":
            h = histogram(mine, d["buckets"], by)
            top = h.filter(F.col("le") == INF)
            parts = [rows(h, f"{d['name']}_bucket", "histogram", "cum_count", "le"),
                     rows(top, f"{d['name']}_sum", "histogram", "sum"),
                     rows(top, f"{d['name']}_count", "histogram", "count")]
        else:
            raise ValueError(f"unknown metric type {d['type']}")
        for part in parts:
            out = part if out is None else out.unionByName(part)
    return out
