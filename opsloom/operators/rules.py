"""Alert rules over event time.

Rules are rows. Every rule looks at the samples of its metric in time order, per rule and series;
ties are broken by ``sample_id``. Nothing here reads the wall clock.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.operators.ordered import (MICROS, asof, by_time, first_in_window, null_safe, previous,
                                       runs, trailing_sum)
from opsloom.session import cut

EQUAL_TOLERANCE = 0.0001
ORDER = ["us", "sample_id"]


def violates(value: Column, comparison: Column, threshold: Column) -> Column:
    """greater / less / equal; text that is no number and unknown comparisons give false."""
    v = value.try_cast("double")
    return F.coalesce(F.when(comparison == "greater", v > threshold)
                      .when(comparison == "less", v < threshold)
                      .when(comparison == "equal", F.abs(v - threshold) < EQUAL_TOLERANCE),
                      F.lit(False))


def check_alerts(latest: DataFrame, rules: DataFrame) -> DataFrame:
    """Latest value of each metric strictly above its threshold."""
    return latest.join(rules, latest["name"] == rules["metric"]).filter(
        F.col("value") > F.col("threshold"))


def hold(df: DataFrame, keys: Sequence[str], flag: str = "violated",
         duration_s: Column | None = None) -> DataFrame:
    """Adds ``run_start`` (start of the current run of ``flag``) and ``fires`` (held long enough)."""
    duration = F.col("duration_s") if duration_s is None else duration_s
    ran = runs(df, keys, ORDER, flag, "us", by_time("us"))
    held = (F.col("us") - F.col("run_start")) >= duration.cast("long") * MICROS
    return ran.withColumn("fires", F.col(flag) & F.coalesce(held, F.lit(False)))


def threshold_rule(samples: DataFrame, rules: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Threshold held for ``duration_s``; a good sample clears the start."""
    joined = samples.join(rules, samples["name"] == rules["metric"])
    flagged = joined.withColumn("violated", violates(F.col("value"), F.col("comparison"),
                                                     F.col("threshold")))
    return hold(flagged, ["rule", *series])


def rate_rule(samples: DataFrame, by: Sequence[str], threshold: float,
              window_s: int = 300) -> DataFrame:
    """(last - first) / seconds over the trailing window; needs two different times."""
    first = first_in_window(samples, by, "us", ["us", "value"], "sample_id", window_s)
    seconds = (F.col("us") - F.col("found.us")) / MICROS
    rate = F.try_divide(F.col("value") - F.col("found.value"), seconds)
    return (first.withColumn("rate", rate)
            .withColumn("fires", F.coalesce(F.abs("rate") > threshold, F.lit(False)))
            .select(*by, "sample_id", "us", "value", "rate", "fires"))


def relative_change(samples: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    """|v - prev| / |prev|; NULL on a zero predecessor, false on the first row."""
    prev = previous(samples, by, ORDER, {"_prev": F.col("value")}, by_time("us"))
    change = F.try_divide(F.abs(F.col("value") - F.col("_prev")), F.abs("_prev"))
    return (prev.withColumn("change", change)
            .withColumn("fires", F.coalesce(F.col("change") > threshold, F.lit(False)))
            .drop("_prev"))


def pattern_rule(log: DataFrame, by: Sequence[str], text: str, regex: str, occurrences: int,
                 window_s: int = 300, duration_s: int = 0) -> DataFrame:
    """At least ``occurrences`` matches in the trailing window, on a matching row.

    With ``duration_s`` the condition must hold that long; it ends when the count drops below.
    """
    matched = log.withColumn("matched", F.coalesce(F.col(text).rlike(regex), F.lit(False)))
    counted = trailing_sum(matched, by, "us", {"matches": F.col("matched").cast("long")}, window_s)
    enough = counted.withColumn("enough", F.col("matches") >= occurrences)
    if not duration_s:
        return enough.withColumn("fires", F.col("enough") & F.col("matched"))
    held = hold(enough, by, "enough", F.lit(duration_s))
    return held.withColumn("fires", F.col("fires") & F.col("matched"))


def cooldown_gap(violations: DataFrame, by: Sequence[str], cooldown_s: int) -> DataFrame:
    """Notify when the previous violation is more than the cooldown ago (first always)."""
    prev = previous(violations, by, ORDER, {"_prev": F.col("us")}, by_time("us"))
    return (prev.withColumn("notify", F.col("_prev").isNull()
                            | (F.col("us") - F.col("_prev") > cooldown_s * MICROS)).drop("_prev"))


def _hops(times: np.ndarray, cooldown: int) -> np.ndarray:
    """Index of the first time more than ``cooldown`` after each time (len = none)."""
    return np.searchsorted(times, times + cooldown, side="right")


def _slice_exits(times: Sequence[int], cooldown: int, start: int) -> list[tuple[int, int]]:
    """How a slice maps the last notification before it to the last one inside it.

    Returns (upto, exit): whoever sends first at or before ``upto`` (and after the previous
    ``upto``) ends the slice with ``exit`` as its last notification.
    """
    times = np.asarray(times)
    hop, n = _hops(times, cooldown), len(times)
    last = np.where(hop < n, hop, np.arange(n))
    while True:     # each step doubles the hops that are followed
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    # An earlier notification lies before the slice, so it can only delay up to start + cooldown.
    reach = min(n, int(np.searchsorted(times, start + cooldown, side="right")) + 1)
    table: list[tuple[int, int]] = []
    for i in range(reach):
        upto, end = int(times[i]), int(times[last[i]])
        if table and table[-1][1] == end:
            table[-1] = (upto, end)
        else:
            table.append((upto, end))
    return table


def _after(table: tuple[Sequence[int], Sequence[int]], sent: int | None, cooldown: int) -> int | None:
    """Last notification at the end of a slice, or block of slices, given the last one before it."""
    upto, leaves = table
    free = 0 if sent is None else int(np.searchsorted(upto, sent + cooldown, side="right"))
    return int(leaves[free]) if free < len(upto) else sent


def _composed(first: tuple, start: int, second: tuple, cooldown: int) -> tuple[list[int], list[int]]:
    """One table for two neighbours: what leaves the first one enters the second; what passes the first one freely
    meets the second directly, which only concerns times up to a cooldown after ``start``."""
    upto = [int(u) for u in first[0]]
    leaves = [_after(second, int(x), cooldown) for x in first[1]]
    reached = upto[-1] if upto else None
    for u, x in zip(*second):
        if reached is not None and reached >= start + cooldown:
            break
        upto.append(int(u))
        leaves.append(int(x))
        reached = int(u)
    last = [i for i in range(len(leaves)) if i + 1 == len(leaves) or leaves[i + 1] != leaves[i]]
    return [upto[i] for i in last], [leaves[i] for i in last]


def cooldown_sent(violations: DataFrame, by: Sequence[str], cooldown_s: int,
                  slice_s: int | None = None, fanout: int = 64) -> DataFrame:
    """Notify when the last *sent* notification is more than the cooldown ago.

    The choice is sequential, so each series is cut into slices. Every slice is reduced, in parallel, to a table
    from "last notification before" to "last notification inside". Such tables compose: ``fanout`` neighbours become
    the table of a block, blocks become larger blocks, round by round until a series is one block; then the rounds are
    walked back, and each block tells its parts with which notification they begin. At last every slice
    replays its own violations from its known start. A table has at most the violation times of one cooldown, a
    group at most ``fanout`` tables or the violations of one slice, however long the series.
    """
    cooldown = cooldown_s * MICROS
    width = (slice_s or max(16 * cooldown_s, 1)) * MICROS
    violations, keys = null_safe(violations, by)
    number = F.expr(f"(us - pmod(us, {width}L)) div {width}L")
    times = violations.select(*keys, "us", number.alias("_slice")).dropDuplicates(
        [*keys, "us", "_slice"]).filter("us IS NOT NULL")
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                           for f in violations.select(*keys).schema.fields)
    given = [F.when(~F.col(f"_null_{k}"), F.col(f"_key_{k}")).alias(k) if k not in keys else F.col(k)
             for k in by]
    table_schema = f"{key_schema}, _slice long, start long, upto array<long>, exits array<long>"

    def named(pdf: pd.DataFrame, out: pd.DataFrame, *cols: str) -> pd.DataFrame:
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, *cols]]

    def reduce_slice(pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(pdf["_slice"].iloc[0])
        table = _slice_exits(np.sort(pdf["us"].to_numpy()), cooldown, at * width)
        return named(pdf, pd.DataFrame({"_slice": [at], "start": [at * width], "upto": [[u for u, _ in table]],
                                        "exits": [[x for _, x in table]]}), "_slice", "start", "upto", "exits")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_slice", ignore_index=True)
        start, table = int(pdf["start"].iloc[0]), (pdf["upto"].iloc[0], pdf["exits"].iloc[0])
        for upto, exits in zip(pdf["upto"].iloc[1:], pdf["exits"].iloc[1:]):
            table = _composed(table, start, (upto, exits), cooldown)
        return named(pdf, pd.DataFrame({"_slice": [int(pdf["_block"].iloc[0])], "start": [start],
                                        "upto": [list(map(int, table[0]))], "exits": [list(map(int, table[1]))]}),
                     "_slice", "start", "upto", "exits")

    def hand_down(entry: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        sent = None if not len(entry) or pd.isna(entry["entry"].iloc[0]) else int(entry["entry"].iloc[0])
        rows = []
        for at, upto, exits in parts.sort_values("_slice")[["_slice", "upto", "exits"]].itertuples(index=False):
            rows.append((at, sent))
            sent = _after((upto, exits), sent, cooldown)
        return named(parts, pd.DataFrame(rows, columns=["_slice", "entry"]).astype({"entry": "Int64"}), "_slice", "entry")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        all_times = np.sort(pdf["us"].to_numpy())
        entry = pdf["entry"].iloc[0]
        i = 0 if pd.isna(entry) else int(np.searchsorted(all_times, int(entry) + cooldown,
                                                         side="right"))
        hop, sent = _hops(all_times, cooldown), []
        while i < len(all_times):
            sent.append(int(all_times[i]))
            i = int(hop[i])
        return named(pdf, pd.DataFrame({"us": np.array(sent, dtype="int64")}), "us")

    parent = F.expr(f"floor(_slice / {int(fanout)})")
    levels = [cut(times.groupBy(*keys, "_slice").applyInPandas(reduce_slice, table_schema), "exits")]
    ends = levels[0].agg(F.min("_slice").alias("low"), F.max("_slice").alias("high")).first()
    first, blocks = ends["low"] or 0, (ends["high"] or 0) - (ends["low"] or 0) + 1
    levels[0] = levels[0].withColumn("_slice", F.col("_slice") - first)        # numbers from 0 on
    while blocks > 1:
        blocks = -(-blocks // fanout)
        levels.append(cut(levels[-1].withColumn("_block", parent).groupBy(*keys, "_block").applyInPandas(
            block, table_schema), "exits"))
    entries = levels[-1].select(*keys, "_slice", F.lit(None).cast("long").alias("entry"))
    for parts in reversed(levels[:-1]):
        whole = entries.withColumnRenamed("_slice", "_block")
        entries = (whole.groupBy(*keys, "_block").cogroup(parts.withColumn("_block", parent).groupBy(*keys, "_block"))
                   .applyInPandas(hand_down, f"{key_schema}, _slice long, entry long"))
    return (times.withColumn("_slice", F.col("_slice") - first).join(entries, [*keys, "_slice"])
            .groupBy(*keys, "_slice").applyInPandas(replay, f"{key_schema}, us long").select(*given, "us"))


def gaps(samples: DataFrame, defs: DataFrame, by: Sequence[str], k: float = 2.0) -> DataFrame:
    """Pauses longer than ``k`` collection intervals."""
    prev = previous(samples.select("collector", *by, "us", "sample_id"), by, ORDER,
                    {"_prev": F.col("us")}, by_time("us"))
    gap = (F.col("us") - F.col("_prev")) / MICROS
    return (prev.withColumn("gap_s", gap).join(defs.select("collector", "interval_s"), "collector")
            .filter(F.col("gap_s") > k * F.col("interval_s")).drop("_prev"))


def conditions_of(rules: DataFrame) -> DataFrame:
    """One row per condition of a composite rule."""
    return rules.select("rule", "operator", F.posexplode("conditions").alias("pos", "c")).select(
        "rule", "operator", "pos", F.col("c.metric").alias("metric"),
        F.col("c.type").alias("type"), F.col("c.comparison").alias("comparison"),
        F.col("c.threshold").alias("threshold"))


def composite_values(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """For every sample of a rule's metric, the last value at that time of each of its metrics.

    Evaluations and metrics without a value yet drop out (a missing metric is skipped).
    """
    cond = conditions_of(rules)
    ticks = (samples.select("sample_id", "us", "name")
             .join(cond.select("rule", F.col("metric").alias("name")).distinct(), "name")
             .select("rule", F.col("sample_id").alias("tick_id"), "us"))
    probes = ticks.join(cond, "rule").withColumnRenamed("metric", "name")
    found = asof(probes, samples.select("name", "us", "value", "sample_id"), ["name"], "us",
                 ["value"], "sample_id")
    return found.filter("found IS NOT NULL").select(
        "rule", "operator", "pos", "tick_id", "us", F.col("name").alias("metric"), "type",
        "comparison", "threshold", F.col("found.value").alias("value"))


def composite_eval(values: DataFrame) -> DataFrame:
    """AND / OR over the conditions that have a value; other operators are false.

    ``triggered`` lists the true conditions; a rule has few conditions, so the list is short.
    """
    truth = values.withColumn("ok", violates(F.col("value"), F.col("comparison"),
                                             F.col("threshold")))
    one = F.when(F.col("ok"), F.struct("pos", "metric", "type", "threshold", "value"))
    out = truth.groupBy("rule", "operator", "tick_id", "us").agg(
        F.bool_and("ok").alias("_all"), F.bool_or("ok").alias("_any"),
        F.sort_array(F.collect_list(one)).alias("triggered"))
    result = F.when(F.col("operator") == "AND", F.col("_all")).when(
        F.col("operator") == "OR", F.col("_any")).otherwise(F.lit(False))
    return out.withColumn("violated", result).drop("_all", "_any")


def composite_rule(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """Hold time on the combined result."""
    combined = composite_eval(composite_values(samples, rules)).withColumnRenamed(
        "tick_id", "sample_id")
    return hold(combined.join(rules.select("rule", "duration_s"), "rule"), ["rule"])
