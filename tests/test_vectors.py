"""Vector search over cells against all pairs, its recall, and rows that can't be compared."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opsloom.operators import vectors
from opsloom.operators.vectors import bounded_sample, cell_sizes, in_cells, knn, learn_cells, nearest


def frame(spark, x, ids=None):
    rows = [(int(i), v.tolist()) for i, v in zip(range(len(x)) if ids is None else ids, x)]
    return spark.createDataFrame(rows, "query_id LONG, embedding ARRAY<DOUBLE>").repartition(4)


def brute(q, b, k, metric):
    if metric == "cosine":
        dist = 1 - (q @ b.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])
    else:
        dist = np.sqrt(((q[:, None, :] - b[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(dist, np.inf)
    out = {}
    for i, row in enumerate(dist):
        order = np.lexsort((np.arange(len(row)), np.round(row, 9)))[:k]
        out[i] = [int(j) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.base_id)
    return out


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("shape", ["spread", "clustered", "hot"])
def test_exact_whatever_the_cells(spark, metric, shape):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((500, 6))
    if shape == "clustered":
        x = rng.integers(-3, 4, (25, 6))[rng.integers(0, 25, 500)] * 4 + 0.1 * x
    if shape == "hot":                                   # a third of all rows in one spot, some of them equal
        x[:170] = 5 + np.round(x[:170], 1) * 0.01
    v = frame(spark, x)
    got = found(knn(v, v.withColumnRenamed("query_id", "base_id"), 4, metric, cells=40, block_bytes=6 * 8 * 60))
    assert got == brute(x, x, 4, metric)


def test_recall_grows_with_probes(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("query_id"), "embedding")
    base = v.withColumnRenamed("query_id", "base_id")
    exact = found(knn(v, base, 5))

    def share(**how):
        got = found(knn(v, base, 5, **how))
        return np.mean([len(set(got.get(q, [])) & set(n)) / len(n) for q, n in exact.items()])

    grown = [share(probes=p) for p in (1, 4, vectors.PROBES, 1000)]
    assert grown == sorted(grown) and grown[2] > 0.8 and grown[3] == 1
    assert share(recall=0.95) >= 0.9


def test_a_hot_cell_is_many_tasks(spark):
    """Most rows in one cell: no group holds more than a block of each side."""
    x = np.concatenate([np.full((600, 3), 2.0) + np.arange(600)[:, None] * 1e-6, np.eye(3)])
    v = frame(spark, x)
    base = v.withColumnRenamed("query_id", "base_id")
    centres = learn_cells(*bounded_sample(base), 2)
    celled = in_cells(base, centres)
    cells = cell_sizes(celled, centres)
    asked = vectors.visits(v, cells, 1, "query_id", "embedding")
    out = vectors.compared(asked, celled, cells, 2, "query_id", "base_id", "embedding", 3 * 8 * 50)
    per = out.groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert per >= 2 * 10                                 # a query met at least ten blocks of its cell
    assert knn(v, base, 2, block_bytes=3 * 8 * 50).count() == 2 * 603


def test_odd_vectors_are_nobodys_neighbours(spark):
    rows = [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 0.0]), (6, [1.0]),
            (7, []), (8, [0.0, 0.0]), (9, [float("inf"), 1.0]), (None, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "query_id LONG, embedding ARRAY<DOUBLE>")
    base = v.withColumnRenamed("query_id", "base_id")
    assert found(knn(v, base, 3)) == {1: [2, 8], 2: [1, 8], 8: [1, 2]}
    assert found(knn(v, base, 3, "cosine")) == {1: [2], 2: [1]}
    empty = v.filter("false")
    assert knn(empty, base, 3).collect() == [] and knn(v, base.filter("false"), 3).collect() == []
    with pytest.raises(ValueError):
        knn(v, base, 3, "dot")


def test_fewer_rows_than_asked(spark):
    x = np.arange(6.0).reshape(3, 2)
    v = frame(spark, x)
    got = knn(v, v.withColumnRenamed("query_id", "base_id"), 50)
    assert found(got) == brute(x, x, 2, "l2") and got.columns == ["query_id", "base_id", "distance", "rank"]
    assert len(nearest(np.array([1]), x[:1], np.array([5, 6]), x[:2], 9)[0]) == 2


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_a_vector_travels_once_to_each_group(spark, metric):
    """Where no cell can be left out, a query is one row for each group of cells, not for each cell."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 24))
    v = frame(spark, x)
    base = v.withColumnRenamed("query_id", "base_id")
    centres = learn_cells(*bounded_sample(base, metric), 40)
    cells = cell_sizes(in_cells(base, centres, metric), centres, metric)
    groups = vectors.grouped(cells, 150)
    assert 3 <= groups.max() + 1 <= 6
    asked = vectors.visits(v, cells, 40, "query_id", "embedding", None, groups).select("query_id", "cell", "cells").collect()
    assert len(asked) == 400 * (groups.max() + 1)
    assert sum(len(r["cells"]) for r in asked) == 400 * (cells.rows > 0).sum()
    assert all(groups[c] == r["cell"] for r in asked for c in r["cells"])
    got = found(knn(v, base, 4, metric, cells=40, block_bytes=24 * 8 * 7, group_bytes=24 * 8 * 150))
    assert got == brute(x, x, 4, metric)


def test_far_from_the_origin_and_equal_rows(spark):
    """Single precision only leaves out what lies beyond the limit by more than its error."""
    rng = np.random.default_rng(4)
    x = np.concatenate([1e6 + rng.standard_normal((150, 5)), np.full((60, 5), 1e6), 1e-12 * rng.standard_normal((90, 5))])
    v = frame(spark, x)
    got = found(knn(v, v.withColumnRenamed("query_id", "base_id"), 3, cells=12, block_bytes=5 * 8 * 16))
    assert got == brute(x, x, 3, "l2")


def test_related_blocks_are_compared_in_slabs():
    rows = pd.DataFrame({"_id": np.arange(4096), "_v": list(np.random.default_rng(5).standard_normal((4096, 32)))})
    tracemalloc.start()
    at, to, score = vectors.above(rows, rows, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4096 * 4096 * 8 / 3                        # all scores at once would take 134 MB
    assert len(at) == len(to) == len(score) and (at != to).all()
