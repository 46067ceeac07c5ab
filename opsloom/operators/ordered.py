"""Ordered computations that never put one whole series into one task.

A window partitioned by series sends every row of a hot series to one task. Here each series is
cut into slices of its order key. Work runs per (series, slice); each slice is also reduced to one
row, those rows are scanned per series, and the carried state is joined back to the slices:

    rows --hash(series, slice)--> local window --\
    rows --partial aggregate--> slice totals --> carry per series --> joined on (series, slice)

The rows shuffle once; the totals are one row per (series, slice). The join reuses the hash
partitioning of the local window, so only the small side moves. A NULL key is a series like any
other: keys enter windows and joins as (is NULL, value or a default).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

MICROS = 1_000_000
HOUR = 3600
_FIRST, _HERE = Window.unboundedPreceding, Window.currentRow


def by_time(us: str | Column, seconds: int = HOUR) -> Column:
    """Slice start (microseconds) for an order key in microseconds."""
    us = F.col(us) if isinstance(us, str) else us
    return us - F.pmod(us, F.lit(seconds * MICROS))


def by_prefix(text: str | Column, length: int = 2) -> Column:
    """Slice by leading characters; fits hash-ordered or alphabetical order keys."""
    return F.left(F.col(text) if isinstance(text, str) else text, F.lit(length))


def _sort(names: Sequence[str], newest_first: bool) -> list[Column]:
    return [F.col(n).desc() if newest_first else F.col(n).asc() for n in names]


Step = Callable[[WindowSpec], Mapping[str, Column]] | Sequence[
    Callable[[WindowSpec], Mapping[str, Column]]]


def _apply(df: DataFrame, window: WindowSpec, steps: Step) -> DataFrame:
    for step in [steps] if callable(steps) else steps:
        df = df.withColumns(dict(step(window)))
    return df


# Values that stand for NULL inside a key; the flag beside them tells the two apart.
_DEFAULTS = {"string": "", "boolean": False, "date": "1970-01-01", "timestamp": "1970-01-01",
             "timestamp_ntz": "1970-01-01"}


def null_safe(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with key columns that equal each other exactly where the given keys do, NULLs too."""
    added: dict[str, Column] = {}
    names: list[str] = []
    for key in keys:
        field = df.schema[key]
        if not field.nullable:
            names.append(key)
            continue
        kind = field.dataType.typeName()
        if kind in ("array", "struct", "map"):
            value, default = F.to_json(F.struct(key)), F.lit("")
        else:
            value, default = F.col(key), F.lit(_DEFAULTS.get(kind, 0)).cast(field.dataType)
        added[f"_null_{key}"] = F.col(key).isNull()
        added[f"_key_{key}"] = F.coalesce(value, default)
        names += [f"_null_{key}", f"_key_{key}"]
    return (df.withColumns(added) if added else df), names


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_col: Column,
                 local: Step, totals: Mapping[str, Column], carried: Step,
                 final: Mapping[str, Column], newest_first: bool = False,
                 totals_of_rows: bool = False) -> DataFrame:
    """Local window per slice, totals per slice, carry across slices, then ``final`` columns.

    ``local`` and ``carried`` are one step or a list of steps, each seeing the columns of the one
    before; all steps share a partitioning and sort. ``totals_of_rows`` aggregates the locally
    windowed rows instead of the input: the same partitioning serves both, but unlike input totals
    they cannot combine before the shuffle.
    """
    safe, keys = null_safe(df, keys)
    sliced = safe.withColumn("_slice", slice_col)
    window = Window.partitionBy(*keys, "_slice").orderBy(*_sort(order, newest_first))
    rows = _apply(sliced, window, local)
    per_slice = (rows if totals_of_rows else sliced).groupBy(*keys, "_slice").agg(
        *[c.alias(n) for n, c in totals.items()])
    across = Window.partitionBy(*keys).orderBy(*_sort(["_slice"], newest_first))
    known = set(per_slice.columns)
    carry = _apply(per_slice, across, carried)
    carry = carry.select(*keys, "_slice", *[c for c in carry.columns if c not in known])
    return (rows.join(carry, [*keys, "_slice"], "left")
            .select(*[F.col(c) for c in df.columns if c not in final],
                    *[c.alias(n) for n, c in final.items()]))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                sums: Mapping[str, Column], slice_col: Column, peers: bool = False) -> DataFrame:
    """Inclusive running sums; ``peers`` includes every row that ties on the order key."""
    def local(w: WindowSpec):
        frame = w.rangeBetween(_FIRST, _HERE) if peers else w.rowsBetween(_FIRST, _HERE)
        return {f"_l_{n}": F.sum(c).over(frame) for n, c in sums.items()}

    return ordered_scan(
        df, keys, order, slice_col, local,
        {f"_t_{n}": F.sum(c) for n, c in sums.items()},
        lambda w: {f"_c_{n}": F.sum(f"_t_{n}").over(w.rowsBetween(_FIRST, -1)) for n in sums},
        {n: F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))
         for n in sums})


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_col: Column,
              out: str = "idx") -> DataFrame:
    """0-based position within ``keys``."""
    return ordered_scan(
        df, keys, order, slice_col,
        lambda w: {"_l_i": F.row_number().over(w)},
        {"_t_n": F.count(F.lit(1))},
        lambda w: {"_c_n": F.sum("_t_n").over(w.rowsBetween(_FIRST, -1))},
        {out: F.col("_l_i") - 1 + F.coalesce(F.col("_c_n"), F.lit(0))})


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str],
             cols: Mapping[str, Column], slice_col: Column) -> DataFrame:
    """``lag(1)`` of each column; the first row of a slice takes the last row before the slice."""
    packed = F.struct(*[c.alias(n) for n, c in cols.items()])
    rank = F.struct(*order)
    out = {n: F.when(F.col("_l_rn") == 1, F.col("_c_prev")[n]).otherwise(F.col("_l_prev")[n])
           for n in cols}
    return ordered_scan(
        df, keys, order, slice_col,
        lambda w: {"_l_rn": F.row_number().over(w), "_l_prev": F.lag(packed).over(w)},
        {"_t_last": F.max_by(packed, rank)},
        lambda w: {"_c_prev": F.lag("_t_last").over(w)},
        out)


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str],
               cols: Mapping[str, Column], slice_col: Column,
               newest_first: bool = False) -> DataFrame:
    """Last non-NULL value up to and including the row, in the given direction."""
    rank = F.struct(*order)
    pick = F.min_by if newest_first else F.max_by
    names = {n: f"_v_{n}" for n in cols}
    src = df.withColumns({names[n]: c for n, c in cols.items()})
    scanned = ordered_scan(
        src, keys, order, slice_col,
        lambda w: {f"_l_{n}": F.last(v, ignorenulls=True).over(w.rowsBetween(_FIRST, _HERE))
                   for n, v in names.items()},
        {f"_t_{n}": pick(F.col(v), F.when(F.col(v).isNotNull(), rank))
         for n, v in names.items()},
        lambda w: {f"_c_{n}": F.last(f"_t_{n}", ignorenulls=True).over(w.rowsBetween(_FIRST, -1))
                   for n in names},
        {n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in names}, newest_first)
    return scanned.drop(*names.values())


def asof(probes: DataFrame, samples: DataFrame, keys: Sequence[str], us: str,
         take: Sequence[str], tie: str, seconds: int = HOUR, forward: bool = False) -> DataFrame:
    """As-of lookup: each probe gets struct ``found`` = last sample at or before it.

    ``forward`` takes the first sample at or after the probe. Both sides are merged into one
    ordered stream, so cost is linear in rows whatever the density of a series. ``tie`` orders
    samples that share a time; probes see every sample with their own time.
    """
    payload = F.struct(*take)
    # Samples sort before probes of the same time in scan direction.
    sample_rank, probe_rank = (1, 0) if forward else (0, 1)
    left = samples.select(*keys, F.col(us).alias("_us"), F.lit(sample_rank).alias("_side"),
                          F.col(tie).alias("_tie"), payload.alias("_sample"),
                          F.lit(None).cast(probes_struct(probes)).alias("_probe"))
    right = probes.select(*keys, F.col(us).alias("_us"), F.lit(probe_rank).alias("_side"),
                          F.lit(None).cast(left.schema["_tie"].dataType).alias("_tie"),
                          F.lit(None).cast(left.schema["_sample"].dataType).alias("_sample"),
                          F.struct(*probes.columns).alias("_probe"))
    merged = last_known(left.unionByName(right), keys, ["_us", "_side", "_tie"],
                        {"found": F.col("_sample")}, by_time("_us", seconds),
                        newest_first=forward)
    return merged.filter("_probe IS NOT NULL").select("_probe.*", "found")


def first_in_window(df: DataFrame, keys: Sequence[str], us: str, take: Sequence[str], tie: str,
                    window_s: int, seconds: int = HOUR) -> DataFrame:
    """Each row with ``found`` = first row of its series at most ``window_s`` seconds older.

    Every row emits itself and a probe at the lower edge of its window; one pass from newest to
    oldest answers all probes, so cost does not grow with the rows per window.
    """
    row_type = probes_struct(df)
    sample = F.struct(F.col(us).alias("_us"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"),
                      F.struct(*take).alias("_sample"), F.lit(None).cast(row_type).alias("_probe"))
    take_type = probes_struct(df.select(*take))
    probe = F.struct((F.col(us) - window_s * MICROS).alias("_us"), F.lit(0).alias("_side"),
                     F.lit(None).cast(df.schema[tie].dataType).alias("_tie"),
                     F.lit(None).cast(take_type).alias("_sample"),
                     F.struct(*df.columns).alias("_probe"))
    events = df.select(*keys, F.inline(F.array(sample, probe)))
    scanned = last_known(events, keys, ["_us", "_side", "_tie"], {"found": F.col("_sample")},
                         by_time("_us", seconds), newest_first=True)
    return scanned.filter("_probe IS NOT NULL").select("_probe.*", "found")


def probes_struct(df: DataFrame):
    return df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType


def trailing_sum(df: DataFrame, keys: Sequence[str], us: str, sums: Mapping[str, Column],
                 window_s: int, inclusive: bool = True, seconds: int = HOUR) -> DataFrame:
    """Sums over the trailing ``window_s`` seconds for every row, in linear time.

    Time is cut into blocks of which a whole number fill the window. A window is then the rows of
    its own block up to now, the whole blocks before, and the rows of its oldest block that are not
    too old. Each row is shown to the block it can be the oldest of, shifted by the window, so both
    open ends are running sums over one partition: up to now, and, backwards, from now on. Amounts are only ever
    added, so a huge or infinite one leaves no trace once it is out of the window. ``inclusive``
    keeps a row exactly ``window_s`` old. ``seconds`` bounds a block.
    """
    width = window_s * MICROS
    blocks = max(1, -(-window_s // seconds))
    while width % blocks:
        blocks += 1
    step = width // blocks
    safe, safe_keys = null_safe(df, keys)
    names = {n: f"_a_{n}" for n in sums}
    valued = safe.withColumns({**{a: F.coalesce(sums[n], F.lit(0)) for n, a in names.items()},
                               "_block": F.col(us) - F.pmod(us, F.lit(step))})
    row = F.struct(*df.columns)
    none = {a: F.lit(None).cast(valued.schema[a].dataType) for a in names.values()}
    here = F.struct(row.alias("_row"), F.col(us).alias("_at"), F.col("_block"),
                    *[F.col(a) for a in names.values()],
                    *[none[a].alias(f"{a}_old") for a in names.values()])
    later = F.struct(F.lit(None).cast(probes_struct(df)).alias("_row"),
                     (F.col(us) + width - (0 if inclusive else 1)).alias("_at"),
                     (F.col("_block") + width).alias("_block"),
                     *[none[a].alias(a) for a in names.values()],
                     *[F.col(a).alias(f"{a}_old") for a in names.values()])
    adds = F.expr(" OR ".join(f"{a} <> 0" for a in names.values()))
    events = valued.select(*safe_keys, F.explode(F.array_compact(F.array(
        here, F.when(adds, later)))).alias("_e")).select(*safe_keys, "_e.*")
    own = Window.partitionBy(*safe_keys, "_block").orderBy("_at")
    # A frame that ends with the partition is summed anew for every row; backwards it is a running sum.
    back = Window.partitionBy(*safe_keys, "_block").orderBy(F.desc("_at"))
    ends = {f"_s_{n}": F.coalesce(F.sum(a).over(own.rangeBetween(_FIRST, _HERE)), F.lit(0))
            + F.coalesce(F.sum(f"{a}_old").over(back.rangeBetween(_FIRST, _HERE)), F.lit(0))
            for n, a in names.items()}
    summed = events.withColumns(ends).filter("_row IS NOT NULL")
    if blocks > 1:
        across = Window.partitionBy(*safe_keys).orderBy("_block").rangeBetween(-(blocks - 1) * step,
                                                                               -step)
        between = (valued.groupBy(*safe_keys, "_block")
                   .agg(*[F.sum(a).alias(a) for a in names.values()])
                   .select(*safe_keys, "_block", *[F.sum(a).over(across).alias(f"_m_{n}")
                                                   for n, a in names.items()]))
        summed = summed.join(between, [*safe_keys, "_block"], "left").withColumns(
            {f"_s_{n}": F.col(f"_s_{n}") + F.coalesce(f"_m_{n}", F.lit(0)) for n in names})
    return summed.select("_row.*", *[F.col(f"_s_{n}").alias(n) for n in names])


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, start: str,
         slice_col: Column, out: str = "run_start") -> DataFrame:
    """Value of ``start`` on the first row of the current run of ``flag``; NULL where it is false.

    A slice is summed up as: all true?, last row true?, start of its last run. Slices that are
    true throughout pass an earlier run on.
    """
    f, rank = F.col(flag), F.struct(*order)
    so_far = lambda w: w.rowsBetween(_FIRST, _HERE)
    before = lambda w: w.rowsBetween(_FIRST, -1)
    local = [
        lambda w: {"_was": F.lag(f).over(w), "_head": F.min(f).over(so_far(w))},
        lambda w: {"_l_s": F.last(F.when(f & ~F.coalesce(F.col("_was"), F.lit(False)),
                                         F.col(start)), ignorenulls=True).over(so_far(w))}]
    totals = {"_t_all": F.bool_and(f), "_t_last": F.max_by(f, rank),
              "_t_tail": F.max_by("_l_s", rank)}
    carried = [
        lambda w: {"_x_opens": F.col("_t_all") & ~F.coalesce(F.lag("_t_all").over(w), F.lit(False)),
                   "_x_cut": F.last(F.when(~F.col("_t_all"), F.struct(
                       F.when(F.col("_t_last"), F.col("_t_tail")).alias("s"))),
                       ignorenulls=True).over(so_far(w))},
        lambda w: {"_x_open": F.last(F.when(F.col("_x_opens"), F.col("_t_tail")),
                                     ignorenulls=True).over(so_far(w))},
        lambda w: {"_x_now": F.when(~F.col("_t_last"), None).when(
            F.col("_t_all"), F.coalesce(F.col("_x_cut.s"), F.col("_x_open"))).otherwise(
            F.col("_t_tail"))},
        lambda w: {"_c_s": F.lag("_x_now").over(w)}]
    mine = F.when(F.col("_head"), F.coalesce("_c_s", "_l_s")).otherwise(F.col("_l_s"))
    return ordered_scan(df, keys, order, slice_col, local, totals, carried,
                        {out: F.when(f, mine)}, totals_of_rows=True)


def keep_newest(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int,
                spread: str, buckets: int = 64) -> DataFrame:
    """Newest ``n`` rows per group, largest ``order`` first.

    A first cut per (group, bucket of ``spread``) runs in parallel even when one group holds most
    rows; the exact cut then sees at most ``n * buckets`` rows per group.
    """
    newest = _sort(order, True)
    bucket = F.pmod(F.xxhash64(spread), F.lit(buckets))
    partial = (df.withColumn("_b", bucket)
               .withColumn("_rn", F.row_number().over(
                   Window.partitionBy(*by, "_b").orderBy(*newest)))
               .filter(F.col("_rn") <= n).drop("_b"))
    exact = partial.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*newest)))
    return exact.filter(F.col("_rn") <= n).withColumnRenamed("_rn", "rank_newest")
