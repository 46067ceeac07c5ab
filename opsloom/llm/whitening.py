"""Whitening of vectors by their leading components, found by Chebyshev-filtered subspace iteration.

Vectors become whole numbers once, in a compact table in the shared folder. With ``V`` the covariance of the numbers,
every step of the iteration is one distributed pass: tasks read their vectors, centre them exactly (``n x - S`` is
a whole number) and add up ``Xc^T (Xc Q)`` for a block ``Q`` of some more columns than components are asked
for; the sums are added up in a fixed number of tasks and only then reach the driver, so that neither ``V`` nor a vector
ever does. A round multiplies the block by a Chebyshev polynomial of ``V`` that stays small on the unwanted part of the
spectrum and grows fast beyond it (scaled three-term recurrence, one pass a degree), makes it orthonormal (QR) and
turns it to Ritz vectors (one pass). The unwanted part reaches from a lower bound of the spectrum, which a Lanczos
vector that rides along in the same passes gives, to the block's least Ritz value. The degree is kept so low that
the columns stay independent. It ends when the residual ``|V q - e q|`` of every component is certified to be at
rounding level; if that fails for ``ROUNDS`` rounds it raises an error.

Results for odd input: rows whose vector is null or holds null or non-finite entries are dropped; so are vectors that are
not as long as most vectors (of equally frequent lengths the longest counts). Repeated vectors and ids count each,
a null id stays. Components whose variance is zero but for rounding can't be whitened and give no rows, so equal vectors,
a single vector and an empty table give an empty result. Ties between eigenvalues are broken as the iteration ends.
Numbers beyond +-2**62 are set to that, and a ``deviation`` that no long can hold is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.session import cut

COMPONENTS = 32
GUARD = 16                     # columns of the block beyond the components
DEGREE = 10                    # highest degree of the filter
SPREAD = 1e7                   # most that a filter may grow the first column over the last component
CERTIFIED = 1e-13              # residual of a component over the largest eigenvalue
ROUNDS = 60
REDUCERS = 16                  # tasks that add up the partial sums of a pass
ROWS = 1 << 16                 # entries of vectors handled together are about 64 times as many
SHIFT, SCALE, WIDEST = 1_000_000, 64.0, 2 ** 62


def encode(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, x``: finite vectors as ``floor(64 c) + 1000000``."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
            numbers = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)    # null entries become NaN
            row = np.repeat(np.arange(len(size)), np.maximum(size, 0))
            good = (size >= 0) & (np.bincount(row[~np.isfinite(numbers)], minlength=len(size)) == 0)
            kept = np.floor(np.clip(numbers[good[row]] * SCALE, -WIDEST, WIDEST)).astype(np.int64) + SHIFT
            ends = np.concatenate([[0], np.cumsum(size[good])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(ends), pa.array(kept))],
                ["vec_id", "x"])

    read = embeddings.select("vec_id", F.col(vector).cast("array<double>").alias("vector"))
    return read.mapInArrow(run, f"vec_id {kind}, x array<long>")


@dataclass
class Whitener:
    """``n`` fitted vectors with exact sums, components as columns by falling eigenvalue, and the trace of ``V``."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def moved(self, x: np.ndarray) -> np.ndarray:
        """``n x - S``, exact: longs where they surely fit, Python's whole numbers otherwise."""
        most = self.n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, self.sums), default=0)
        if most < WIDEST:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.moved(x).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)


def matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with their vectors as a matrix, of bounded size."""
    rows = max(1, ROWS * 64 // d)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column(part.schema.get_field_index("x")).flatten().to_numpy().reshape(-1, d)


def added_up(vectors: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | float:
    """The sum of ``of(matrix of vectors)`` over all vectors, added up in tasks before it reaches the driver."""
    def total(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        value = None
        for part in parts:
            value = part if value is None else value + part
        if value is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(value).tobytes()])], ["part"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return total(np.asarray(of(x), np.float64) for _, x in matrices(batches, d))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return total(np.frombuffer(p.as_py()) for batch in batches for p in batch.column(0))

    parts = vectors.select("x").mapInArrow(first, "part binary").repartition(REDUCERS).mapInArrow(again, "part binary")
    return sum(np.frombuffer(r.part) for r in parts.collect())


def exact_sums(vectors: DataFrame, d: int) -> list[int]:
    """Sums of each dimension as whole numbers of any length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * d
        for _, x in matrices(batches, d):
            wide = np.abs(x).max(initial=0) * len(x) >= WIDEST
            own = x.astype(object).sum(axis=0) if wide else x.sum(axis=0)
            sums = [a + int(b) for a, b in zip(sums, own)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(map(str, sums))], ["at", "s"])

    rows = (vectors.select("x").mapInArrow(run, "at int, s string").groupBy("at")
            .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    return [int(r.s) for r in sorted(rows)]


class Lanczos:
    """Lower bound of a spectrum from products with one vector after the other."""

    def __init__(self, d: int, seed: np.random.Generator):
        v = seed.standard_normal(d)
        self.basis, self.diagonal, self.beside = [v / np.linalg.norm(v)], [], []

    @property
    def vector(self) -> np.ndarray:
        return self.basis[-1]

    def take(self, product: np.ndarray) -> None:
        """``product`` is ``V`` times the last vector."""
        self.diagonal.append(float(self.vector @ product))
        basis = np.array(self.basis)
        rest = product
        for _ in range(2):
            rest = rest - basis.T @ (basis @ rest)
        size = float(np.linalg.norm(rest))
        self.beside.append(size)
        if size <= 1e-10 * max(map(abs, self.diagonal)):
            rest, self.beside[-1] = np.zeros_like(rest), 0.0
        self.basis.append(rest / size if self.beside[-1] else rest)

    def least(self) -> float:
        """The least Ritz value less its residual; 0 as long as there is nothing better."""
        if len(self.diagonal) < 2:
            return 0.0
        inner = self.beside[:-1]
        values, vectors = np.linalg.eigh(np.diag(self.diagonal) + np.diag(inner, 1) + np.diag(inner, -1))
        return max(0.0, values[0] - self.beside[-1] * abs(vectors[-1, 0]))

    @property
    def done(self) -> bool:
        return bool(self.beside) and self.beside[-1] == 0.0 or len(self.diagonal) >= len(self.basis[0])


def degree(first: float, last: float, low: float, high: float) -> int:
    """Highest degree whose polynomial grows ``first`` no more than ``SPREAD`` over ``last``; both are above ``high``."""
    def growth(value: float, n: int) -> float:
        return n * np.arccosh(max(1.0, (2 * value - high - low) / (high - low)))
    return max([n for n in range(1, DEGREE + 1) if growth(first, n) - growth(last, n) <= np.log(SPREAD)], default=1)


def leading(times: Callable[[np.ndarray], np.ndarray], d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their unit eigenvectors of the symmetric ``d x d`` matrix behind ``times``."""
    seed = np.random.default_rng(11)
    m = min(d, k + GUARD)
    q, _ = np.linalg.qr(seed.standard_normal((d, m)))
    below = Lanczos(d, seed)

    def product(block: np.ndarray) -> np.ndarray:
        if m == d or below.done:
            return times(block)
        out = times(np.column_stack([block, below.vector]))
        below.take(out[:, -1])
        return out[:, :-1]

    for _ in range(ROUNDS):
        vq = product(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residual = np.linalg.norm(vq - q * values, axis=0)[:k].max(initial=0)
        if residual <= CERTIFIED * max(values[0], 0):
            return values[:k], q[:, :k]
        if m == d:                                             # the block is the whole space: only rounding is left
            q, _ = np.linalg.qr(q)
            continue
        low, high = below.least(), values[-1]
        if values[k - 1] - high <= 1e-6 * values[0]:           # ties reach beyond the block: damp what is below them
            high = (min(low, high) + high) / 2
        low = min(low, high - 1e-3 * (values[0] - high))
        half, middle = (high - low) / 2, (high + low) / 2
        start = half / (values[0] - middle)
        scale = start
        before, now = q, (product(q) - middle * q) * (scale / half)
        for _ in range(1, degree(values[0], values[k - 1], low, high)):
            after = 1 / (2 / start - scale)
            before, now = now, (product(now) - middle * now) * (2 * after / half) - scale * after * before
            scale = after
        q, _ = np.linalg.qr(now / np.maximum(np.linalg.norm(now, axis=0), 1e-300))
    raise RuntimeError(f"residual {residual} isn't at rounding level after {ROUNDS} rounds")


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitener, DataFrame] | None:
    """The whitener of all encoded vectors of the most frequent length, and these vectors; None if there are none."""
    lengths = vectors.groupBy(F.size("x").alias("d")).count()
    usual = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None or not usual["d"]:
        return None
    d, n = usual["d"], usual["count"]
    vectors = vectors.where(F.size("x") == d)
    own = Whitener(n, exact_sums(vectors, d), np.zeros((d, 0)), np.zeros(0), 0.0)
    own.trace = float(added_up(vectors, d, lambda x: np.array([np.square(own.centred(x)).sum()]))[0]) / n
    if own.trace == 0:
        return own, vectors

    def times(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = own.centred(x)
            return centred.T @ (centred @ block)
        return added_up(vectors, d, part).reshape(block.shape) / n

    values, found = leading(times, d, min(components, d))
    real = values > 1e-12 * values[0]
    return Whitener(n, own.sums, found[:, real], values[real], own.trace), vectors


def identity_error(vectors: DataFrame, own: Whitener) -> float:
    """Largest entry of the covariance of the whitened vectors minus the identity."""
    d, k = own.components.shape
    mean = added_up(vectors, d, lambda x: own.whitened(x).sum(axis=0)) / own.n

    def part(x: np.ndarray) -> np.ndarray:
        centred = own.whitened(x) - mean
        return centred.T @ centred
    return float(np.abs(added_up(vectors, d, part).reshape(k, k) / own.n - np.eye(k)).max())


def transform(vectors: DataFrame, own: Whitener) -> DataFrame:
    """``vec_id, deviation, whitened``: each encoded vector's exact distance and its list of whitened coordinates."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    d, k = own.components.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in matrices(batches, d):
            moved = own.moved(x)
            fits = moved.dtype != object and int(np.abs(moved).max(initial=0)) ** 2 * d < 2 ** 63
            far = np.square(moved if fits else moved.astype(object)).sum(axis=1).tolist()
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f if f < 2 ** 63 else None for f in far], pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(own.whitened(x).ravel()))],
                ["vec_id", "deviation", "whitened"])

    return vectors.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def whiten(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    fitted = fit(cut(encode(embeddings, vector), "vectors"), components)
    if fitted is None or not len(fitted[0].values):
        return embeddings.sparkSession.createDataFrame([], (
            f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
            "identity_error double"))
    own, vectors = fitted
    share = F.array(*[F.lit(float(v / own.trace)) for v in own.values])
    rows = transform(vectors, own).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(own.n).cast("long").alias("n"),
                       "deviation", "whitened", F.element_at(share, F.col("at") + 1).alias("explained"),
                       F.lit(identity_error(vectors, own)).alias("identity_error"))
