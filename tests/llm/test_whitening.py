import numpy as np
import pytest

from opsloom.llm import whitening
from opsloom.llm.whitening import leading, whiten


def plain(rows):
    """x, eigenvalues, eigenvectors and covariance trace of the remaining vectors, all at once."""
    x = np.floor(64 * np.array([v for _, v in rows], dtype=np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    return x, centred, values[::-1], vectors[:, ::-1], np.trace(v), ((n * x - s).astype(object) ** 2).sum(axis=1)


def check(got, rows, k):
    x, centred, values, vectors, trace, far = plain(rows)
    n, by = len(rows), {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == n * k and {c for m in by.values() for c in m} == set(range(1, k + 1))
    want = centred @ vectors[:, :k] / np.sqrt(values[:k])
    mine = np.array([[by[i][c].whitened for c in range(1, k + 1)] for i, _ in rows])
    signs = np.sign((mine * want).sum(axis=0))
    gap = np.abs(np.diff(values))[:k].min() / values[0]
    assert np.abs(mine - want * signs).max() < 1e-11 / gap + 1e-9
    for at, (i, _) in enumerate(rows):
        for c in range(1, k + 1):
            r = by[i][c]
            assert (r.n, r.deviation) == (n, far[at])
            assert abs(r.explained * trace / values[c - 1] - 1) < 1e-10 and r.identity_error < 1e-9


def test_every_vector(tables):
    table = tables("embeddings")
    check(whiten(table).collect(), [(r.vec_id, r.embedding) for r in table.collect()], 32)


@pytest.mark.parametrize("tail", ["flat", "steep", "ties"])
def test_iteration_against_a_whole_decomposition(tail):
    d, k, seed = 120, 12, np.random.default_rng(3)
    values = {"flat": np.concatenate([np.linspace(9, 2, k), 1 + 0.05 * seed.random(d - k)]),
              "steep": 10.0 ** -np.linspace(0, 9, d), "ties": np.repeat([5.0, 3.0, 1.0, 0.5], d // 4)}[tail]
    q, _ = np.linalg.qr(seed.standard_normal((d, d)))
    v = q * values @ q.T
    passes = []
    got, vectors = leading(lambda block: (passes.append(1), v @ block)[1], d, k)
    assert np.allclose(got, np.sort(values)[::-1][:k], rtol=0, atol=1e-12 * values.max())
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.linalg.norm(v @ vectors - vectors * got, axis=0).max() < 1e-12 * values.max()
    assert len(passes) < 120


def test_few_vectors_of_rank_two(spark):
    seed = np.random.default_rng(4)
    base = seed.integers(-9, 9, (2, 70)).astype(float)
    rows = [(i, (seed.integers(-5, 5, 2) @ base).tolist()) for i in range(40)]
    got = whiten(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2}
    check(got, rows, 2)


def test_odd_rows_and_columns(spark):
    seed = np.random.default_rng(5)
    good = [(i, seed.standard_normal(5).tolist()) for i in range(30)] + [(3, [0.5] * 5)]
    bad = [(90, None), (91, [1.0, None, 2.0, 3.0, 4.0]), (92, [float("nan")] * 5), (93, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
           (94, []), (95, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1, "a", 2.0) for i, v in good + bad],
                                  "vec_id long, embedding array<float>, n int, x string, whitened double")
    got = whiten(table).collect()
    assert len(got) == 31 * 5 and {r.vec_id for r in got} == set(range(30)) and got[0].identity_error < 1e-9
    assert sum(r.vec_id == 3 for r in got) == 10


def test_wide_numbers_are_exact_or_null(spark):
    rows = [(0, [1e15, 0.0]), (1, [-1e15, 1.0]), (2, [3.0, 2.0]), (None, [1e300, -1e300])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) in (4, 8) and all(r.deviation is None for r in got)
    near = whiten(spark.createDataFrame([(0, [2e9, 0.0]), (1, [0.0, 2e9])], "vec_id long, embedding array<double>"))
    assert {r.deviation for r in near.collect()} == {None} or {r.deviation for r in near.collect()} == {2 * (128 * 10**9) ** 2}


def test_nothing_to_whiten(spark, tables):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened",
                                                       "explained", "identity_error"]


def test_blocks_of_rows_change_nothing(tables, monkeypatch):
    rows = [(r.vec_id, r.embedding) for r in tables("embeddings").limit(60).collect()]
    table = tables("embeddings").sparkSession.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(whitening, "ROWS", 3)
    check(whiten(table, components=3).collect(), rows, 3)
