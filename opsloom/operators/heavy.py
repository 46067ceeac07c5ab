"""Joins that stay even when a few keys have a large share of all rows.

Keys above a share are found by a mergeable summary of bounded size (frequent items, merged task by task), so no key is
counted by shuffling its rows. Rows of a heavy key are dealt over several parts by a hash of the row, the rows
of the other side are copied to each of these parts, and every other key has one part. Results are those of a plain
join, row for row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.session import small_table

TRACKED = 4096        # keys that a summary follows at most; its error is about 1 / TRACKED of all rows
SHARE = 0.005         # share of all rows from which a key is heavy
PARTS = 256           # most parts of one key


def heavy_keys(df: DataFrame, key: str, share: float = SHARE) -> list[tuple[object, float]]:
    """Keys that hold at least ``share`` of the rows with their share, largest first; at most ``1 / share`` of them.

    Shares may be too high by the summary's error, never too low; NULL is no key.
    """
    if not 2 / TRACKED <= share <= 1:
        raise ValueError(f"share must lie in {2 / TRACKED}..1")
    most = int(1 / share) + 1
    row = df.filter(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k({key}, {most}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [(r["item"], r["count"] / row["n"]) for r in row["top"] if r["count"] >= share * row["n"]] if row["n"] else []


def parts_of(keys: list[tuple[object, float]], share: float) -> list[tuple[object, int]]:
    """How many parts each heavy key gets, so that a part has at most about ``share`` of all rows."""
    return [(k, min(PARTS, max(2, -int(-s // share)))) for k, s in keys]


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: float = SHARE,
               heavy: list[tuple[object, float]] | None = None) -> DataFrame:
    """``left JOIN right USING (key)`` with the rows of keys that are heavy in ``left`` dealt over several parts.

    ``heavy`` are keys found before, for a ``left`` that holds part of the same rows; without it they are looked for.

    ``how`` is inner, left, left_semi or left_anti. The right side should be small for one key, since its rows of
    a heavy key are copied. The table of heavy keys has at most ``1 / share`` rows, which bounds what is broadcast.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} can't be split by its left side")
    keys = parts_of(heavy_keys(left, key, share) if heavy is None else heavy, share)
    if not keys:
        return left.join(right, key, how)
    kind = dict(left.dtypes)[key]
    table = small_table(left.sparkSession, f"{key} {kind}, _parts INT", keys)

    def parts(df: DataFrame) -> tuple[DataFrame, Column]:
        return df.join(F.broadcast(table), key, "left"), F.coalesce("_parts", F.lit(1))

    one, n = parts(left)
    one = one.withColumn("_part", F.pmod(F.xxhash64(*left.columns), n).cast("int")).drop("_parts")
    other, n = parts(right)
    other = other.withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1))).drop("_parts")
    return one.join(other, [key, "_part"], how).drop("_part")
