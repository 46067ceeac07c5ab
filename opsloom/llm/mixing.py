"""Mixing sources to target weights by Poisson replication.

A source of ``size`` characters and target share ``w`` of a budget of ``budget`` characters gets the rate
``budget * w / size``: so often, on average, each of its documents is repeated. A document's count is the inverse of
the Poisson distribution function at a number hashed from the seed and its ``doc_id``, so any run and any
partitioning gives the same counts. Rates above ``BLOCK_RATE`` are sums of independent parts of smaller rate, each
with its own number, so no rate is too large for the table of the distribution. Documents are exploded by their
counts and dealt out by a hash of seed, document and copy, in whose order the result's partitions lie: a
global shuffle. Only DataFrame functions are used, and texts move once.

Without weights a source's share follows ``size ** temperature``. The rates have one row per source; up to
``BROADCAST_SOURCES`` of them are broadcast, more are joined by source and salt, so one source with a third
of all rows is spread either way.

Defined results: a null source is a source of its own; null and empty texts have size 0; a source of size 0 has
rate 1; sources missing from given weights have rate 0 and go; rows that repeat a ``doc_id`` get equal counts;
rows without an id share one number; an empty table gives an empty result. Columns named ``copy`` or
``mix_key`` in the input are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.session import cut

BLOCK_RATE = 4.0
TERMS = 33                   # the chance of 33 or more at rate 4 is below 2**-52
BROADCAST_SOURCES = 10_000
SALTS = 64
TEMPERATURE = 0.5
SEED = "mix"
FACTORIALS = [float(math.factorial(j)) for j in range(TERMS)]


def hashed(*parts, digits: int) -> Column:
    """A whole number of ``digits`` hexadecimal digits from the md5 of the parts."""
    named = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) if isinstance(p, Column) else F.lit(p)
                               for p in parts])
    return F.conv(F.substring(F.md5(named), 1, digits), 16, 10).cast("long")


def distribution(rate: Column) -> Column:
    """The Poisson distribution function at 0, 1, ... for a rate of at most ``BLOCK_RATE``."""
    terms = F.transform(F.array(*[F.lit(f) for f in FACTORIALS]),
                        lambda f, j: F.exp(-rate) * F.pow(rate, j.cast("double")) / f)
    return F.transform(F.sequence(F.lit(1), F.lit(TERMS)),
                       lambda k: F.aggregate(F.slice(terms, F.lit(1), k), F.lit(0.0), lambda a, x: a + x))


def source_sizes(docs: DataFrame) -> DataFrame:
    """Characters of each source."""
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return docs.groupBy("source").agg(F.sum(size).alias("size"))


def source_rates(sizes: DataFrame, weights: dict[str | None, float] | None = None,
                 temperature: float = TEMPERATURE, budget: float | None = None) -> DataFrame:
    """``source, rate``: the mean repetitions of each source's documents."""
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for source, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(w))).otherwise(weight)
    weighed = sizes.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(F.lit(0.0)))
    total, mass = weighed.agg(F.sum("size"), F.sum("weight")).first()
    spend = float(total or 0) if budget is None else float(budget)
    share = F.lit(spend) * F.col("weight") / F.lit(float(mass or 1.0))
    return weighed.select("source", F.when(F.col("size") > 0, share / F.col("size")).otherwise(1.0).alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None,
                temperature: float = TEMPERATURE, budget: float | None = None, seed: str = SEED,
                broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """``docs`` repeated to the target shares, with ``copy`` (from 1) and ``mix_key``, in shuffled order."""
    own = [c for c in docs.columns if c not in ("copy", "mix_key")]
    rates = source_rates(cut(source_sizes(docs), "sizes"), weights, temperature, budget)
    parts = F.greatest(F.ceil(F.col("rate") / BLOCK_RATE), F.lit(1)).cast("int")
    table = rates.select(F.coalesce("source", F.lit("")).alias("__name"),
                         F.col("source").isNull().alias("__null"), parts.alias("__parts"),
                         distribution(F.col("rate") / parts).alias("__cdf"))
    named = docs.select(*own, F.coalesce("source", F.lit("")).alias("__name"),
                        F.col("source").isNull().alias("__null"))
    if rates.limit(broadcast_sources + 1).count() <= broadcast_sources:
        met = named.join(F.broadcast(table), ["__name", "__null"])
    else:
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = named.withColumn("__salt", salt).join(salted, ["__name", "__null", "__salt"])
    number = F.col("doc_id")

    def drawn(part: Column) -> Column:
        u = hashed(seed, number, part, digits=13) / F.lit(float(2 ** 52))
        return F.size(F.filter("__cdf", lambda c: c <= u))

    count = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("__parts")), drawn), F.lit(0), lambda a, x: a + x)
    copies = (met.withColumn("__count", count).where("__count > 0")
              .select(*own, F.explode(F.sequence(F.lit(1), F.col("__count"))).alias("copy")))
    keyed = copies.withColumn("mix_key", hashed(seed, number, F.col("copy"), "order", digits=15))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key", "doc_id", "copy")


def mix_sql(rows: str = "documents", temperature: float = TEMPERATURE, seed: str = SEED) -> str:
    """``mix_sources`` without given weights as DuckDB SQL over a table or subquery."""
    factorials = ", ".join(repr(f) for f in FACTORIALS)

    def h(tail: str, digits: int) -> str:
        named = f"'{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || {tail}"
        return f"CAST('0x' || substr(md5({named}), 1, {digits}) AS BIGINT)"

    return f"""
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0)) AS size FROM {rows} GROUP BY source),
weighed AS (SELECT source, CAST(size AS DOUBLE) AS size,
    CASE WHEN size > 0 THEN pow(CAST(size AS DOUBLE), {temperature}) ELSE 0.0 END AS weight FROM sizes),
rates AS (SELECT source, CASE WHEN size > 0 THEN (SELECT sum(size) FROM weighed) * weight
    / (SELECT sum(weight) FROM weighed) / size ELSE 1.0 END AS rate FROM weighed),
blocks AS (SELECT source, greatest(CAST(ceil(rate / {BLOCK_RATE}) AS INT), 1) AS parts, rate FROM rates),
terms AS (SELECT source, parts, [exp(-rate / parts) * pow(rate / parts, x.j) / x.f FOR x IN
    list_transform(range(1, {TERMS + 1}), lambda i: {{'j': i - 1, 'f': ([{factorials}])[i]}})] AS t FROM blocks),
cdfs AS (SELECT source, parts, list_transform(range(1, {TERMS + 1}), lambda k: list_sum(t[1:k])) AS cdf FROM terms),
counted AS (SELECT d.*, list_sum(list_transform(range(1, parts + 1), lambda b: len(list_filter(cdf, lambda c:
    c <= {h("CAST(b AS VARCHAR)", 13)} / 4503599627370496.0)))) AS n
  FROM {rows} d JOIN cdfs ON d.source IS NOT DISTINCT FROM cdfs.source),
copies AS (SELECT * EXCLUDE (n), CAST(unnest(range(1, CAST(n AS BIGINT) + 1)) AS INT) AS copy FROM counted)
SELECT *, {h("CAST(copy AS VARCHAR) || ':order'", 15)} AS mix_key FROM copies"""
