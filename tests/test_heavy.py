"""Joins with a key that holds a third of all rows."""

import pytest
from pyspark.sql import functions as F

from opsloom.operators.heavy import heavy_keys, parts_of, split_join


@pytest.fixture(scope="module")
def left(spark):
    """6000 rows: a third with one key, a twentieth with another, the rest spread, some without."""
    key = (F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 20 == 1, "warm").when(F.col("id") % 50 == 2, None)
           .otherwise(F.concat(F.lit("k"), (F.col("id") % 1500).cast("string"))))
    return spark.range(6000).select(key.alias("k"), F.col("id").alias("a")).repartition(8)


@pytest.fixture(scope="module")
def right(spark):
    rows = [("hot", 1), ("hot", 2), ("warm", 3), ("k7", 4), ("k7", 5), ("nowhere", 6), (None, 7)]
    return spark.createDataFrame(rows, "k STRING, b LONG")


def test_heavy_keys_and_their_parts(spark, left):
    keys = heavy_keys(left, "k", 0.02)
    assert [k for k, _ in keys] == ["hot", "warm"]
    assert abs(keys[0][1] - 1 / 3) < 0.02
    assert parts_of(keys, 0.02)[0][1] >= 16
    assert heavy_keys(left.filter("false"), "k") == [] and heavy_keys(left.filter("k IS NULL"), "k") == []
    assert heavy_keys(spark.range(5000), "id", 0.01) == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_rows_as_a_plain_join(left, right, how):
    got = sorted(map(str, split_join(left, right, "k", how, 0.02).collect()))
    assert got == sorted(map(str, left.join(right, "k", how).collect()))
    none = split_join(left.filter("k <> 'hot' AND k <> 'warm'"), right, "k", how, 0.02)
    assert "_part" not in none.columns


def test_no_task_reads_many_times_the_median(spark, left, right):
    """Rows of the hot key are dealt over parts: the largest (key, part) is near the share that was asked for."""
    keys = parts_of(heavy_keys(left, "k", 0.005), 0.005)
    n = dict(keys)["hot"]
    sizes = (left.filter("k = 'hot'").groupBy(F.pmod(F.xxhash64("k", "a"), F.lit(n))).count()
             .agg(F.max("count"), F.count("*")).first())
    assert sizes[0] <= 3 * 0.005 * 6000 and sizes[1] >= n * 0.9


def test_wrong_arguments(left, right):
    with pytest.raises(ValueError):
        split_join(left, right, "k", "full")
    with pytest.raises(ValueError):
        heavy_keys(left, "k", 1e-9)
