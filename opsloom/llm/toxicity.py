"""Toxicity categories by a classifier chain.

The categories are predicted one after the other by sparse linear models over the hashed words that a text
has and the beginnings of those words, which tie together the forms of a word that few texts have; each model also
gets the probabilities of the categories before it. In training those come from models that have not seen
the row (out-of-fold), so a later model learns how far an earlier one can be trusted. A model only looks at features
that stand out among its training rows. The out-of-fold probabilities of the last category also set the cut, halfway
to the first text that would spoil its precision, so that clean texts are left alone. The models are fitted on
a bounded sample of labelled rows. Words are runs of letters and digits, so signs around a word hide nothing; letters
count as small ones.

The labels name one category, ``toxic``. The categories before it are kinds of toxic rows, found by clustering the
features that stand out in them, in whatever language they are; for a kind, toxic rows of other kinds are
unknown and left out of its training.

Defined results: null and empty texts have no words and score as the intercepts say; without labelled rows
every probability is 0.5 and nothing is toxic (the cut lies above 0.5); repeated rows score alike; rows
without an id are scored too; an empty table gives an empty result. A text counts as a set of features, so a very long one
costs time in proportion to its length and a bounded number of features at most. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.linear import Row, fit_ftrl, squash
from opsloom.llm.samples import fold_of, labelled_sample
from opsloom.llm.tokens import LOWER_CODES, NOT_ALNUM, U64, Chunk, chunks, mix, random_words

SAMPLE_ROWS = 20_000
BITS = 19
FOLDS = 3
BEGINNINGS = (4, 6, 8)   # bytes of the beginnings that longer words have as features
KINDS = 4        # kinds of toxic rows, fewer if there are few such rows
KIND_ROWS = 20   # toxic rows for each kind
LEAST_ROWS = 3   # sampled rows of a category that must have a feature for it to count
STANDS_OUT = 4.0 # standard deviations by which a feature must be more frequent in them than in all rows
COUNTED_ROWS = 512
L1 = 6.0         # a feature must pull this hard to get a weight: those of a few rows by chance do not
CUT = 0.5 + 1e-9  # least probability that may count as toxic
PRECISION = 0.99  # share of truly toxic rows among those called toxic, on out-of-fold predictions


@dataclass
class Chain:
    """Weights of each category: hashed words, earlier categories, intercept."""

    names: list[str]
    words: np.ndarray      # categories x 2**bits
    earlier: np.ndarray    # categories x categories
    intercept: np.ndarray
    bits: int
    cut: float = CUT       # probability of the last category from which a text is toxic

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        """Probabilities from the word part of the margins, category after category."""
        out = np.zeros_like(sums)
        for k in range(len(self.names)):
            out[:, k] = squash(sums[:, k] + out[:, :k] @ self.earlier[k, :k] + self.intercept[k])
        return out

    def of_words(self, feature: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """Probabilities of texts from the distinct words each has."""
        sums = [np.bincount(owner, w[feature], minlength=texts).astype(float) for w in self.words]
        return self.probabilities(np.column_stack(sums))


def present(chunk: Chunk, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed features of each text and the text each belongs to."""
    owner = chunk.text_of_word()
    hashes, owners = [chunk.hashes()], [owner]
    for n in BEGINNINGS:
        long = chunk.ends - chunk.starts > n
        start = chunk.starts[long]
        hashes.append(mix(chunk.ranges(LOWER_CODES[chunk.data], start, start + n) ^ random_words(1, 60 + n)[0]))
        owners.append(owner[long])
    feature = (np.concatenate(hashes) >> U64(64 - bits)).astype(np.int64)
    key = np.unique((np.concatenate(owners) << bits) | feature)
    return key & ((1 << bits) - 1), key >> bits


def sampled(sample: DataFrame, target: str, bits: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Ids, features and target of a bounded sample, in an order by hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1), NOT_ALNUM):
                feature, owner = present(chunk, bits)
                ends = np.searchsorted(owner, np.arange(chunk.n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, chunk.n),
                     pa.ListArray.from_arrays(ends, pa.array(feature.astype(np.int32))),
                     batch.column(2).slice(chunk.first, chunk.n)], names=["doc_id", "i", "y"])

    rows = (sample.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col(target).cast("int"))
            .mapInArrow(run, "doc_id long, i array<int>, y int").toArrow())
    ids, at, y = rows["doc_id"].to_numpy(), rows["i"].combine_chunks(), rows["y"].to_numpy()
    order = np.lexsort((y, ids, mix(ids.astype(np.int64).view(U64))))
    return ids[order], [at[int(k)].values.to_numpy() for k in order], y[order]


def standing_out(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Which features are so much more frequent in rows of the category (1) than in all that it can't be chance."""
    def counts(chosen: np.ndarray) -> np.ndarray:
        total = np.zeros(size, int)
        for at in range(0, len(chosen), COUNTED_ROWS):      # never the features of all rows in one array
            total += np.bincount(np.concatenate([rows[r] for r in chosen[at:at + COUNTED_ROWS]]), minlength=size)
        return total

    own, every = counts(np.flatnonzero(y == 1)), counts(np.arange(len(rows)))
    rate = float((y == 1).mean()) if len(y) else 0.0
    spread = np.sqrt(np.maximum(every * rate * (1 - rate), 1e-12))
    return (own >= LEAST_ROWS) & (own - every * rate >= STANDS_OUT * spread)


def kinds_of(rows: list[np.ndarray], toxic: np.ndarray, size: int, kinds: int, rounds: int = 10) -> np.ndarray:
    """A kind for each toxic row, -1 for the others, by clustering what stands out in toxic rows (cosine).

    Each kind starts from the row that is least like those of the kinds before it.
    """
    out = np.full(len(rows), -1)
    at = np.flatnonzero(toxic == 1)
    kinds = min(kinds, len(at) // KIND_ROWS)
    if kinds < 2:
        return out
    named = np.flatnonzero(standing_out(rows, toxic, size))
    place = np.full(size, -1)
    place[named] = np.arange(len(named)) % 512             # bounded width whatever stands out
    x = np.zeros((len(at), 512))
    for k, r in enumerate(at):
        own = place[rows[r]]
        np.add.at(x[k], own[own >= 0], 1.0)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    named_rows = x[x.any(axis=1)]
    if not len(named_rows):
        return out
    centre = [named_rows.mean(axis=0)]
    for _ in range(kinds):
        centre.append(named_rows[np.argmin(np.max(named_rows @ np.array(centre).T, axis=1))])
    centre = np.array(centre[1:])
    for _ in range(rounds):
        near = np.argmax(x @ centre.T, axis=1)
        for k in range(kinds):
            if (near == k).any():
                mean = x[near == k].mean(axis=0)
                centre[k] = mean / max(np.linalg.norm(mean), 1e-12)
    out[at] = near
    return out


def fit_chain(ids: np.ndarray, rows: list[np.ndarray], targets: np.ndarray, names: list[str], bits: int,
              folds: int = FOLDS) -> Chain:
    """The chain fitted category by category on out-of-fold probabilities of the earlier ones.

    ``targets`` has a column for each category, -1 where it is unknown.
    """
    size, k_all = 1 << bits, len(names)
    chain = Chain(names, np.zeros((k_all, size), dtype=np.float32), np.zeros((k_all, k_all)),
                  np.zeros(k_all), bits)
    fold = fold_of(ids, folds) if len(ids) else np.zeros(0, dtype=int)
    before = np.zeros((len(rows), k_all))

    def learn(chosen: np.ndarray, k: int) -> np.ndarray:
        use = standing_out([rows[r] for r in chosen], targets[chosen, k], size)
        extra = size + np.arange(k)
        own: list[Row] = []
        for r in chosen:
            i = rows[r][use[rows[r]]]
            own.append((np.append(i, extra), np.append(np.ones(len(i)), before[r, :k])))
        return fit_ftrl(own, targets[chosen, k].astype(float), size + k, alpha=0.3, l1=L1, l2=0.01, passes=3, free=k)

    for k in range(k_all):
        known = np.flatnonzero(targets[:, k] >= 0)
        for f in range(folds):
            w = learn(known[fold[known] != f], k)
            for r in np.flatnonzero(fold == f):
                before[r, k] = squash(w[rows[r]].sum() + before[r, :k] @ w[size:size + k] + w[-1])
        w = learn(known, k)
        chain.words[k], chain.earlier[k, :k], chain.intercept[k] = w[:size], w[size:size + k], w[-1]
    known = targets[:, -1] >= 0
    chain.cut = least_cut(before[known, -1], targets[known, -1])
    return chain


def least_cut(p: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The least probability, ``CUT`` at least, above which enough of the rows are of the category: halfway, in log
    odds, from the last row that may be called so to the next one below it."""
    order = np.argsort(-p, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(p) + 1)
    good = np.flatnonzero((share >= precision) & (y[order] == 1))
    if not len(good):
        return CUT
    last = float(p[order[good[-1]]])
    below = p[p < last]
    odds = [np.log(q / (1 - q)) for q in np.clip([last, below.max() if len(below) else 0.5], 1e-9, 1 - 1e-9)]
    return max(CUT, float(squash(np.mean(odds))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, bits: int = BITS, kinds: int = KINDS) -> Chain:
    """The chain fitted on at most ``rows`` labelled documents."""
    ids, found, toxic = sampled(labelled_sample(docs, labels, ["toxic"], rows), "toxic", bits)
    toxic = np.minimum(toxic, 1)
    kind = kinds_of(found, toxic, 1 << bits, kinds)
    targets = [np.where(kind == k, 1, np.where(toxic == 1, -1, 0)) for k in range(kind.max(initial=-1) + 1)]
    names = [f"kind{k + 1}" for k in range(len(targets))] + ["toxic"]
    return fit_chain(ids, found, np.column_stack([*targets, toxic]), names, bits)


def predict(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id``, a probability for each category and ``is_toxic`` (the last category reaches the cut)."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{n}" for n in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for chunk in chunks(batch.column(1), NOT_ALNUM):
                feature, owner = present(chunk, model.bits)
                p = model.of_words(feature, owner, chunk.n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, chunk.n), *[pa.array(x) for x in p.T],
                     pa.array(p[:, -1] >= model.cut)], names=["doc_id", *names, "is_toxic"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", is_toxic boolean")


def without_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` without the rows judged toxic, all columns as they were; nothing is joined or shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for chunk in chunks(batch.column(place), NOT_ALNUM):
                feature, owner = present(chunk, model.bits)
                p = model.of_words(feature, owner, chunk.n)
                keep[chunk.first:chunk.first + chunk.n] = p[:, -1] < model.cut
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
