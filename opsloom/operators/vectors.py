"""Vector search over learnt cells (J12, D17) and near vectors by sign patterns (D11 on vectors).

Rows without an id and vectors that are null, hold nulls or non-finite entries, or differ in length from the cells are
no neighbours of anything; under cosine that also holds for vectors of length zero. What a task holds is
bounded by ``GROUP_BYTES``, what it compares at once by ``BLOCK_BYTES`` and ``SLAB``; what is broadcast (cell centres and their radii, random directions) has a size
that parameters bound, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.session import cut, small_table

BLOCK_BYTES = 4 << 20      # vectors of one side that a task compares at once
GROUP_BYTES = 16 << 20     # vectors of one side that a task of a search holds
SAMPLE_BYTES = 16 << 20    # vectors from which cells are learnt
CENTRE_BYTES = 8 << 20     # all centres
PROBES = 10                # cells that a query visits
ROUNDS = 6                 # rounds in which centres are moved
SLAB = 512
EXACT = 1 << 16            # pairs whose exact distances are taken at once
PENDING = 3                # candidates kept for each neighbour asked for before the best are chosen
SLACK = 1e-8               # distances closer than this count as equal when a bound decides


# ---------------------------------------------------------------- cells

@dataclass
class Cells:
    """Centres, and for each the number of base rows in it and the largest distance from the centre."""

    centres: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    metric: str

    @property
    def d(self) -> int:
        return self.centres.shape[1]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clean(df: DataFrame, key: str, vec: str, d: int | None = None, metric: str = "l2") -> DataFrame:
    """Rows with an id and a usable vector."""
    x = F.col(vec)
    good = F.col(key).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists(
        x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    if d is not None:
        good = good & (F.size(x) == d)
    if metric == "cosine":
        good = good & F.exists(x, lambda c: c != 0)
    return df.filter(good)


def matrix(column: pd.Series, metric: str = "l2") -> np.ndarray:
    x = np.stack(column.to_numpy()).astype("float64")
    return unit(x) if metric == "cosine" else x


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None, :] - 2.0 * a @ b.T, 0.0))


def moved_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres that start at evenly spread sample rows and move to the mean of the rows nearest to them."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([distances(sample[at:at + SLAB], centres).argmin(axis=1)
                              for at in range(0, len(sample), SLAB)])
        count = np.bincount(own, minlength=cells)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def bounded_sample(base: DataFrame, metric: str = "l2", key: str = "base_id", vec: str = "embedding",
                   sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, int]:
    """At most ``sample_bytes`` of usable vectors, chosen by a hash of their ids, and the number of all of them."""
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    lengths = clean(base, key, vec, metric=metric).groupBy(F.size(vec).alias("d")).count()
    usual = lengths.orderBy(F.desc("count"), "d").first()
    if usual is None:
        return np.zeros((0, 1)), 0
    d, n = usual["d"], usual["count"]
    take = max(1, sample_bytes // (8 * d))
    sample = (clean(base, key, vec, d, metric).orderBy(F.xxhash64(key), key).limit(take).select(vec).toPandas())
    return matrix(sample[vec], metric), n


def learn_cells(sample: np.ndarray, n: int, cells: int | None = None) -> np.ndarray:
    """Centres of cells for ``n`` rows: about the root of ``n``, as far as they stay within ``CENTRE_BYTES``."""
    if not len(sample):
        return sample
    most = max(1, min(CENTRE_BYTES // (8 * sample.shape[1]), len(sample)))
    return moved_centres(sample, min(most, cells or max(1, round(n ** 0.5))))


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int = 256) -> int:
    """Cells a query must visit so that ``recall`` of its neighbours are found, by the neighbours within the sample.

    Among all rows neighbours are nearer than in the sample and so lie in nearer cells: the number is on the safe side.
    """
    if len(sample) < 2:
        return 1
    own = np.concatenate([distances(sample[at:at + SLAB], centres).argmin(axis=1) for at in range(0, len(sample), SLAB)])
    order = np.argsort(distances(sample[:asked], centres), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
    near = distances(sample[:asked], sample)
    near[np.arange(len(near)), np.arange(len(near))] = np.inf
    near = np.argpartition(near, min(k, len(sample) - 1) - 1, axis=1)[:, :min(k, len(sample) - 1)]
    ranks = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1


def in_cells(base: DataFrame, centres: np.ndarray, metric: str = "l2", key: str = "base_id",
             vec: str = "embedding") -> DataFrame:
    """``key, vec, cell, away``: every usable base row in the cell of its nearest centre."""
    kinds = dict(base.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), SLAB):
                pdf = whole.iloc[at:at + SLAB]
                d = distances(matrix(pdf[vec], metric), centres)
                yield pdf.assign(cell=d.argmin(axis=1).astype("int32"), away=d.min(axis=1))

    rows = clean(base.select(key, vec), key, vec, centres.shape[1], metric)
    return rows.mapInPandas(run, f"{key} {kinds[key]}, {vec} {kinds[vec]}, cell int, away double")


def cell_sizes(celled: DataFrame, centres: np.ndarray, metric: str = "l2") -> Cells:
    """Rows and radius of each cell; one row for each cell reaches the driver."""
    out = Cells(centres, np.zeros(len(centres), int), np.zeros(len(centres)), metric)
    for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect():
        out.rows[r.cell], out.radius[r.cell] = r.n, r.r
    return out


# ---------------------------------------------------------------- search

def nearest(ids, vectors, base_ids, base, k, metric="l2"):
    """Best ``k`` base rows of every query as (query, base, distance) arrays, ties to the smaller id."""
    square = metric == "cosine"                # of unit vectors, half the squared distance
    take, found = min(k, len(base_ids)), []
    for at in range(0, len(ids), SLAB):
        mine, v = ids[at:at + SLAB], vectors[at:at + SLAB]
        dist = distances(v, base)
        dist = dist ** 2 / 2 if square else dist
        dist[mine[:, None] == base_ids[None, :]] = np.inf
        limit = np.partition(dist, take - 1, axis=1)[:, take - 1:take]
        rows, cols = np.nonzero((dist <= limit + SLACK) & np.isfinite(dist))
        # sums of squares lose digits near 0, so distances that stay are taken from differences
        near = ((v[rows] - base[cols]) ** 2).sum(axis=1)
        near = near / 2 if square else np.sqrt(near)
        order = np.lexsort((base_ids[cols], np.round(near, 9), rows))
        rows, cols, near = rows[order], cols[order], near[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < take
        found.append((mine[rows[keep]], base_ids[cols[keep]], near[keep]))
    return [np.concatenate(part) for part in zip(*found)]


def squared(distance, metric: str):
    """The squared distance that belongs to a distance, ties included that differ by rounding only."""
    reach = np.asarray(distance, float) + SLACK
    return (2 * reach if metric == "cosine" else reach ** 2) * (1 + 1e-14)


def chosen(row: np.ndarray, col: np.ndarray, near: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Which candidates are the ``k`` best of their row, ordered by row and rank; ``place`` decides ties."""
    order = np.lexsort((place[col], np.round(near, 9), row))
    return order[np.arange(len(order)) - np.searchsorted(row[order], row[order], side="left") < k]


def nearest_in_cells(q: pd.DataFrame, b: pd.DataFrame, cells: Cells, k: int, block: int):
    """Best ``k`` rows of the cells each query looks into, as (query, base, distance) arrays, ties to the smaller id.

    ``q`` has ``_id, _v, cells`` and a distance ``_reached`` beyond which nothing counts, ``b`` has ``_id, _v, own``.
    A cell is compared ``SLAB`` queries and ``block`` rows at a time by one product of vectors from the cell's centre. It
    is taken in single precision and only leaves out pairs that lie beyond the limit by more than its error; the
    distances of the others are taken from differences.
    """
    ids, v = q["_id"].to_numpy(), matrix(q["_v"], cells.metric)
    b = b.iloc[np.argsort(b["own"].to_numpy(), kind="stable")]
    base_ids, base = b["_id"].to_numpy(), matrix(b["_v"], cells.metric)
    place = np.unique(base_ids, return_inverse=True)[1]
    own, first = np.unique(b["own"].to_numpy(), return_index=True)
    ends = np.append(first[1:], len(b))
    looks = np.repeat(np.arange(len(q)), q["cells"].map(len).to_numpy())
    into = np.concatenate(q["cells"].to_numpy())
    looks = looks[np.argsort(into, kind="stable")]
    into = np.sort(into)
    limit = squared(q["_reached"].fillna(np.inf).to_numpy(float), cells.metric)
    kept = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    parts, pending, d = [kept], 0, cells.d

    def settle() -> None:
        nonlocal kept, parts, pending
        row, col, near = (np.concatenate(x) for x in zip(*parts))
        best_of = chosen(row, col, near, place, k)
        kept = (row[best_of], col[best_of], near[best_of])
        last = np.searchsorted(kept[0], np.arange(len(q)), side="right") - 1
        full = np.bincount(kept[0], minlength=len(q)) == k
        limit[full] = np.minimum(limit[full], squared(kept[2][last[full]], cells.metric))
        parts, pending = [kept], 0

    for cell, low, high in zip(own, first, ends):
        rows = looks[np.searchsorted(into, cell, side="left"):np.searchsorted(into, cell, side="right")]
        if not len(rows):
            continue
        x, y = v[rows] - cells.centres[cell], base[low:high] - cells.centres[cell]
        xx, yy = (x ** 2).sum(axis=1), (y ** 2).sum(axis=1)
        span = (np.sqrt(xx) + np.sqrt(yy.max())) ** 2
        kind, unit_error = (np.float32, 2.0 ** -22) if span.max() < 1e30 else (np.float64, 2.0 ** -50)
        error = (d + 16) * unit_error * span + 1e-36
        x = np.column_stack([x, xx, np.ones(len(x))]).astype(kind)
        y = np.column_stack([-2 * y, np.ones(len(y)), yy]).astype(kind)
        for at in range(0, len(rows), SLAB):
            mine, slab, more = rows[at:at + SLAB], x[at:at + SLAB], error[at:at + SLAB]
            for to in range(0, high - low, block):
                square = slab @ y[to:to + block].T
                begin, wide = low + to, square.shape[1]
                open_rows = np.flatnonzero(np.isinf(limit[mine]))
                if len(open_rows) and wide > k:
                    some = square[open_rows]
                    some[ids[mine[open_rows]][:, None] == base_ids[None, begin:begin + wide]] = np.inf
                    kth = np.partition(some, k - 1, axis=1)[:, k - 1].astype(float) + more[open_rows]
                    away = kth / 2 if cells.metric == "cosine" else np.sqrt(np.maximum(kth, 0))
                    limit[mine[open_rows]] = squared(away, cells.metric)
                least = np.nextafter((limit[mine] + more).astype(kind), kind(np.inf))
                flat = np.flatnonzero((square <= least[:, None]).ravel())
                for some in range(0, len(flat), EXACT):
                    row, col = np.divmod(flat[some:some + EXACT], wide)
                    row, col = mine[row], col + begin
                    near = ((v[row] - base[col]) ** 2).sum(axis=1)
                    good = np.flatnonzero((near <= limit[row]) & (ids[row] != base_ids[col]) & np.isfinite(near))
                    near = near[good] / 2 if cells.metric == "cosine" else np.sqrt(near[good])
                    parts.append((row[good], col[good], near))
                    pending += len(good)
                    if pending > PENDING * k * len(q):
                        settle()
    settle()
    return ids[kept[0]], base_ids[kept[1]], kept[2]


def grouped(cells: Cells, held: int) -> np.ndarray:
    """A group for each cell: neighbouring cells with about ``held`` rows in all, or one cell with more."""
    groups = max(1, -(-int(cells.rows.sum()) // held))
    if not len(cells.centres):
        return np.zeros(0, "int32")
    away = distances(cells.centres, moved_centres(cells.centres, min(groups, len(cells.centres))))
    out, group, room = np.zeros(len(cells.centres), "int32"), 0, held
    for c in np.lexsort((away.min(axis=1), away.argmin(axis=1))):
        if cells.rows[c] > room and room < held:
            group, room = group + 1, held
        out[c], room = group, room - cells.rows[c]
    return out


def visits(queries: DataFrame, cells: Cells, probes: int, qid: str, vec: str, reached: str | None = None,
           groups: np.ndarray | None = None) -> DataFrame:
    """``qid, vec, cell, cells, _reached``: the cells each query looks into, one row for each group that has any.

    ``cell`` is the group, without ``groups`` each cell is one. Without ``reached`` these are the ``probes`` nearest
    cells that hold rows. With it, a column with the distance of the k-th neighbour found so far, they are the
    further cells in which the triangle inequality allows a nearer one. However many cells of a group a query looks
    into, its vector travels to the group once.
    """
    kind = dict(queries.dtypes)[qid]
    group = np.arange(len(cells.rows), dtype="int32") if groups is None else groups
    filled = np.flatnonzero(cells.rows)
    filled = filled[np.argsort(group[filled], kind="stable")]
    centres, radius, group = cells.centres[filled], cells.radius[filled], group[filled]
    probes = min(probes, len(filled))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), SLAB):
                pdf = whole.iloc[at:at + SLAB]
                d = distances(matrix(pdf[vec], cells.metric), centres)
                first = np.zeros(d.shape, bool)
                near = np.argpartition(d, probes - 1, axis=1)[:, :probes]
                np.put_along_axis(first, near, True, axis=1)
                so_far = np.full(len(pdf), np.inf)
                if reached is not None:
                    so_far = pdf[reached].fillna(np.inf).to_numpy(float)
                    limit = so_far[:, None] + SLACK
                    limit = np.sqrt(2 * limit) if cells.metric == "cosine" else limit
                    first = ~first & (d - radius <= limit + SLACK)
                rows, cols = np.nonzero(first)
                starts = np.flatnonzero(np.diff(rows, prepend=-1) | np.diff(group[cols], prepend=-1))
                at_row = rows[starts]
                yield pd.DataFrame({qid: pdf[qid].to_numpy()[at_row], vec: pdf[vec].to_numpy()[at_row],
                                    "cell": group[cols[starts]],
                                    "cells": pd.Series(np.split(filled[cols].astype("int32"), starts[1:])[:len(starts)],
                                                       dtype=object),
                                    "_reached": so_far[at_row]})

    rows = clean(queries, qid, vec, cells.d, cells.metric)
    return rows.mapInPandas(run, f"{qid} {kind}, {vec} {dict(queries.dtypes)[vec]}, cell int, cells array<int>, "
                                 "_reached double")


def in_blocks(asked: DataFrame, stored: DataFrame, rows: Mapping[int, int], d: int, qid: str, bid: str, vec: str,
              compare: Callable, block_bytes: int) -> DataFrame:
    """``qid, bid, distance`` of whatever ``compare`` finds between the two sides of each cell.

    It gets both sides with their ids and vectors as ``_id, _v`` beside the other columns.
    A cell's queries and rows are dealt over as many blocks as their number asks for, by a hash of their ids, and
    every block of one side meets every block of the other, so a cell with most rows is many tasks. ``rows`` has the
    stored rows of each cell; the queries of each are counted here, one row a cell reaches the driver.
    """
    held = max(1, block_bytes // (8 * d))
    wanted = asked.groupBy("cell").count().collect()
    parts = [(r["cell"], -(-r["count"] // held), -(-rows[r["cell"]] // held)) for r in wanted if rows.get(r["cell"])]
    kinds = {qid: dict(asked.dtypes)[qid], bid: dict(stored.dtypes)[bid]}
    schema = f"{qid} {kinds[qid]}, {bid} {kinds[bid]}, distance double"
    if not parts:
        return asked.sparkSession.createDataFrame([], schema)
    grid = F.broadcast(small_table(asked.sparkSession, "cell INT, q_parts INT, b_parts INT", parts))

    def dealt(df: DataFrame, key: str, own: str, other: str, own_part: str, other_part: str) -> DataFrame:
        return (df.join(grid, "cell").select(
            F.col(key).alias("_id"), F.col(vec).alias("_v"), *[c for c in df.columns if c not in (key, vec)],
            F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(own_part),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_part)))

    left = dealt(asked, qid, "q_parts", "b_parts", "_qp", "_bp")
    right = dealt(stored, bid, "b_parts", "q_parts", "_bp", "_qp")

    def cell(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = compare(q, b) if len(q) and len(b) else ([], [], [])
        return pd.DataFrame(dict(zip((qid, bid, "distance"), out)))

    keys = ["cell", "_qp", "_bp"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, schema)


def compared(asked: DataFrame, celled: DataFrame, cells: Cells, k: int, qid: str, bid: str, vec: str,
             block_bytes: int, groups: np.ndarray | None = None, group_bytes: int | None = None) -> DataFrame:
    """The ``k`` best rows of each query within each part of a group of cells, as ``visits`` asks for them.

    A task holds ``group_bytes`` of vectors of each side and compares them ``block_bytes`` at a time.
    """
    block = max(1, block_bytes // (8 * cells.d))
    group = np.arange(len(cells.rows), dtype="int32") if groups is None else groups
    rows = {g: int(n) for g, n in enumerate(np.bincount(group, cells.rows))}
    spark = celled.sparkSession
    of_cell = F.broadcast(spark.createDataFrame(
        pd.DataFrame({"own": np.arange(len(group), dtype="int32"), "cell": group}), "own int, cell int"))
    stored = celled.select(bid, vec, F.col("cell").alias("own")).join(of_cell, "own")

    def compare(q: pd.DataFrame, b: pd.DataFrame):
        return nearest_in_cells(q, b, cells, k, block)

    return in_blocks(asked, stored, rows, cells.d, qid, bid, vec, compare, group_bytes or block_bytes)


def best(found: DataFrame, k: int, qid: str, bid: str) -> DataFrame:
    order = Window.partitionBy(qid).orderBy(F.round("distance", 9), bid)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", qid: str = "query_id",
        bid: str = "base_id", vec: str = "embedding", probes: int | None = None, recall: float | None = None,
        cells: int | None = None, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``k`` nearest base vectors of every query (a vector is not its own neighbour).

    Base rows lie in cells learnt from a bounded sample. Each query looks into its ``probes`` nearest cells, or into as
    many as the sample shows to be needed for a ``recall``. With neither the result is exact: after the ``PROBES`` nearest cells the distance of the k-th neighbour bounds which
    other cells can hold a nearer one, and those are looked into as well. Neighbouring cells form groups of
    ``group_bytes``; vectors travel once to each group met, so what is shuffled grows with groups, not with cells, where
    no cell can be left out. Neither queries nor base rows reach the driver. Cosine distance is half the squared distance of unit vectors, so the same bound serves it.
    """
    sample, n = bounded_sample(base, metric, bid, vec)
    centres = learn_cells(sample, n, cells)
    if recall is not None and probes is None:
        probes = probes_for(sample, centres, k, recall)
    celled = cut(in_cells(base, centres, metric, bid, vec), "celled")
    sizes = cell_sizes(celled, centres, metric)
    queries = cut(queries.select(qid, vec), "queries")       # read several times below
    group_bytes = max(group_bytes, block_bytes)
    groups = grouped(sizes, max(1, group_bytes // (8 * sizes.d)))
    asked = visits(queries, sizes, probes or PROBES, qid, vec, None, groups)
    found = best(compared(asked, celled, sizes, k, qid, bid, vec, block_bytes, groups, group_bytes), k, qid, bid)
    if probes is None and (sizes.rows > 0).sum() > PROBES:
        found = cut(found, "near")
        reached = found.filter(F.col("rank") == k).select(qid, F.col("distance").alias("_reached"))
        further = visits(queries.join(reached, qid, "left"), sizes, PROBES, qid, vec, "_reached", groups)
        more = compared(further, celled, sizes, k, qid, bid, vec, block_bytes, groups, group_bytes)
        found = best(found.drop("rank").unionByName(more), k, qid, bid)
    return found.select(qid, bid, "distance", "rank")


# ---------------------------------------------------------------- related vectors

PLANES = 12                # most bits of a sign pattern
PATTERN_ROWS = 64          # rows that a pattern should have


def directions(d: int, planes: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((d, planes))


def patterns(x: np.ndarray, across: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` sign patterns to look into, for unit vectors: the own one, then those with least margins flipped.

    A pattern's cost is the sum of the squared margins of its flipped bits.
    """
    margins = x @ across
    own = (margins > 0) @ (1 << np.arange(across.shape[1]))
    if probes == 1:
        return own[:, None]
    flips = np.arange(1 << across.shape[1])
    bits = (flips[:, None] >> np.arange(across.shape[1])) & 1
    cost = margins ** 2 @ bits.T
    near = np.argsort(cost, axis=1, kind="stable")[:, :probes] if probes < len(flips) else np.tile(flips, (len(x), 1))
    return own[:, None] ^ near


def probes_for_angle(sample: np.ndarray, across: np.ndarray, cosine: float, recall: float, asked: int = 512) -> int:
    """Patterns to look into so that a vector at just this cosine, in any direction, is found with chance ``recall``."""
    x = sample[:asked]
    side = np.random.default_rng(9).standard_normal(x.shape)
    side = unit(side - (side * x).sum(1, keepdims=True) * x + 1e-300)
    theirs = patterns(cosine * x + np.sqrt(max(0.0, 1 - cosine ** 2)) * side, across, 1)
    place = np.sort((patterns(x, across, 1 << across.shape[1]) == theirs).argmax(axis=1))
    return int(place[min(len(place) - 1, int(np.ceil(recall * len(place))))]) + 1


def above(q: pd.DataFrame, b: pd.DataFrame, cosine: float):
    """Pairs of different rows with at least this cosine, ``SLAB`` rows by one block at a time."""
    ids, other_ids = q["_id"].to_numpy(), b["_id"].to_numpy()
    v, other, found = matrix(q["_v"], "cosine"), matrix(b["_v"], "cosine").T, []
    for low in range(0, len(ids), SLAB):
        score = v[low:low + SLAB] @ other
        at, to = np.nonzero(score >= cosine - SLACK)
        apart = ids[low + at] != other_ids[to]
        at, to = at[apart], to[apart]
        found.append((ids[low + at], other_ids[to], score[at, to]))
    return [np.concatenate(part) for part in zip(*found)]


def related_vectors(df: DataFrame, cosine: float, key: str = "id", vec: str = "embedding", recall: float | None = 0.95,
                    planes: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """D11 on vectors: pairs (src, dst, score), src < dst, of vectors with at least this cosine.

    Equal vectors are folded first: each hangs on its first row with score 1 and takes no part in comparisons. The others lie
    in the cell of their sign pattern under random directions and look into further patterns in the order of the
    margins they would have to cross, as many as find a pair at the threshold with chance ``recall`` in one
    direction alone, measured on a bounded sample; pairs are confirmed by their cosine. ``recall=None`` looks into all
    patterns and is exact.
    """
    if not -1 <= cosine <= 1:
        raise ValueError("a cosine lies in -1..1")
    good = clean(df.select(key, vec), key, vec, metric="cosine")
    firsts = good.groupBy(F.xxhash64(vec).alias("_h"), vec).agg(F.min(key).alias("_first"))
    held = cut(good.join(firsts.select("_h", F.col(vec).alias("_v"), "_first"),
                         (F.xxhash64(vec) == F.col("_h")) & (F.col(vec) == F.col("_v"))).select(key, "_first"), "held")
    copies = held.filter(F.col(key) > F.col("_first")).select(
        F.col("_first").alias("src"), F.col(key).alias("dst"), F.lit(1.0).alias("score"))
    rows = cut(firsts.select(F.col("_first").alias("id"), vec), "firsts")
    sample, n = bounded_sample(rows, "cosine", "id", vec)
    if not n:
        return copies
    d = sample.shape[1]
    bits = planes if planes is not None else int(np.clip(np.log2(max(1, n / PATTERN_ROWS)), 0, PLANES))
    across = directions(d, bits)
    probes = 1 << bits if recall is None else probes_for_angle(sample, across, cosine, recall)
    kinds = dict(rows.dtypes)

    def placed(looked: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for at in range(0, len(whole), SLAB):
                    pdf = whole.iloc[at:at + SLAB]
                    cells = patterns(matrix(pdf[vec], "cosine"), across, looked)
                    each = np.repeat(np.arange(len(pdf)), cells.shape[1])
                    yield pd.DataFrame({"id": pdf["id"].to_numpy()[each], vec: pdf[vec].to_numpy()[each],
                                        "cell": cells.ravel().astype("int32")})
        return clean(rows, "id", vec, d, "cosine").mapInPandas(run, f"id {kinds['id']}, {vec} {kinds[vec]}, cell int")

    stored = cut(placed(1).withColumnRenamed("id", "other"), "patterns")
    sizes = {r["cell"]: r["count"] for r in stored.groupBy("cell").count().collect()}     # one row for each pattern

    def compare(q: pd.DataFrame, b: pd.DataFrame):
        return above(q, b, cosine)

    met = in_blocks(placed(probes), stored, sizes, d, "id", "other", vec, compare, block_bytes)
    pairs = (met.groupBy(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"))
             .agg(F.max("distance").alias("score")).filter(F.round("score", 9) >= cosine))
    return copies.unionByName(pairs)
