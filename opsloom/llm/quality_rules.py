"""Quality rules: statistics of whole texts judged by gradient-boosted trees.

The statistics come from numpy over many texts at once. The trees are grown on a bounded sample of labelled
rows with logistic loss; features named in ``MONOTONE`` may move the verdict in one direction only, so more
symbols or more repetition never make a text better. A fitted model is a handful of flat node arrays; scoring
steps all rows of a batch down all trees level by level.

Defined results: a null text counts as empty; an empty text has no words and fails the base rules; texts of any
length are read whole; without labels of both kinds the trees are empty and only the base rules decide.
Rows that repeat are judged each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.samples import labelled_sample
from opsloom.llm.tokens import CODES, CONTINUES, SPACE, U64, Chunk, chunks, mix, runs_of

SAMPLE_ROWS = 20_000
FEATURES = ["log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share",
            "digit_share", "punct_share", "distinct_share", "words_per_line", "top_word_share",
            "same_as_before_share"]
# Directions in which a feature may move the score.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
            "same_as_before_share": -1}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def byte_set(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


SYMBOLS = byte_set("#*$%&|<>")
UPPER = byte_set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = byte_set("0123456789")
PUNCT = byte_set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def within_text(values: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Values made distinct between texts."""
    with np.errstate(over="ignore"):
        return mix(values + texts.astype(U64) * U64(0xC2B2AE3D27D4EB4F))


def duplicate_lines(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """For each text: lines with a word that equal an earlier one, and all lines with a word."""
    breaks = np.flatnonzero(chunk.data == 10)
    starts = np.unique(np.concatenate((chunk.offsets[:-1], breaks + 1)))
    starts = starts[starts < len(chunk.data)]
    if not len(starts):
        return np.zeros(chunk.n, dtype=np.int64), np.zeros(chunk.n, dtype=np.int64)
    limits = np.append(starts[1:], len(chunk.data))
    ends = np.where(chunk.data[limits - 1] == 10, limits - 1, limits)
    solid = np.concatenate(([0], np.cumsum(~SPACE[chunk.data])))
    worded = solid[ends] > solid[starts]
    starts, ends = starts[worded], ends[worded]
    text = np.searchsorted(chunk.offsets, starts, side="right") - 1
    names = within_text(Chunk.ranges(CODES[chunk.data], starts, ends), text)
    _, first = np.unique(names, return_index=True)
    lines = np.bincount(text, minlength=chunk.n)
    return lines - np.bincount(text[first], minlength=chunk.n), lines


def repeated_words(chunk: Chunk, hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each text: words inside a 3-word window that the text has twice or more."""
    if len(hashes) < 3:
        return np.zeros(chunk.n, dtype=np.int64)
    whole = texts[:-2] == texts[2:]
    at = np.flatnonzero(whole)
    _, inverse, times = np.unique(within_text(runs_of(hashes, 3)[at], texts[at]), return_inverse=True,
                                  return_counts=True)
    at = at[times[inverse] > 1]
    covered = np.zeros(len(hashes), dtype=bool)
    for j in range(3):
        covered[at + j] = True
    return np.bincount(texts[covered], minlength=chunk.n)


def distinct_and_top(chunk: Chunk, hashes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: distinct words and occurrences of the most frequent one."""
    _, first, times = np.unique(within_text(hashes, texts), return_index=True, return_counts=True)
    top = np.zeros(chunk.n, dtype=np.int64)
    np.maximum.at(top, texts[first], times)
    return np.bincount(texts[first], minlength=chunk.n), top


def statistics(chunk: Chunk) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of the base rules and the feature matrix of a chunk's texts."""
    hashes, texts, words = chunk.hashes(lower=False), chunk.text_of_word(), chunk.counts
    dup_lines, lines = duplicate_lines(chunk)
    repeat = repeated_words(chunk, hashes, texts)
    distinct, top = distinct_and_top(chunk, hashes, texts)
    same = np.zeros(chunk.n, dtype=np.int64)
    if len(hashes) > 1:
        again = (hashes[1:] == hashes[:-1]) & (texts[1:] == texts[:-1])
        same = np.bincount(texts[1:][again], minlength=chunk.n)
    chars = chunk.per_text(~SPACE[chunk.data] & ~CONTINUES[chunk.data])
    symbols, upper = chunk.per_text(SYMBOLS[chunk.data]), chunk.per_text(UPPER[chunk.data])
    digits, punct = chunk.per_text(DIGIT[chunk.data]), chunk.per_text(PUNCT[chunk.data])
    n, c = np.maximum(words, 1), np.maximum(chars, 1)
    features = np.column_stack([
        np.log1p(words), chars / n, symbols / c, dup_lines / np.maximum(lines, 1), repeat / n, upper / c,
        digits / c, punct / c, distinct / n, words / np.maximum(lines, 1), top / n, same / n])
    counts = dict(zip(COUNTS, (words, chars, symbols, dup_lines, repeat)))
    return counts, features


@dataclass
class Trees:
    """Flat nodes of all trees: an inner node tests ``feature > threshold``; a leaf's children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if not len(self.roots) or not len(x):
            return total
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] > self.threshold[at], self.right[at], self.left[at])
        return total + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, directions: np.ndarray, trees: int = 60, depth: int = 4,
              rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Gradient boosting with logistic loss on binned features.

    A split on a feature with a direction counts only if the children's values follow it; the middle between
    them then bounds everything below, so the whole tree is monotone in that feature.
    """
    nodes: list[list[float]] = []
    roots: list[int] = []
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)
            for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    margin = np.full(len(y), base)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + ridge), low, high))

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        nodes.append([0, np.inf, me, me, leaf(g, h, low, high) * rate])
        if level == depth or len(rows) < 2 * least:
            return me
        best = None
        for f in range(x.shape[1]):
            if not len(cuts[f]):
                continue
            b = binned[rows, f]
            size = len(cuts[f]) + 1
            gl = np.cumsum(np.bincount(b, grad[rows], size))[:-1]
            hl = np.cumsum(np.bincount(b, hess[rows], size))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
            vl = np.clip(-gl / (hl + ridge), low, high)
            vr = np.clip(-(g - gl) / (h - hl + ridge), low, high)
            gain = gl ** 2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g ** 2 / (h + ridge)
            fair = (nl >= least) & (len(rows) - nl >= least) & (directions[f] * (vr - vl) >= 0)
            gain = np.where(fair, gain, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = (gain[k], f, k, vl[k], vr[k])
        if best is None:
            return me
        _, f, k, vl, vr = best
        middle = (vl + vr) / 2
        left_high = middle if directions[f] > 0 else high
        left_low = middle if directions[f] < 0 else low
        right_low = middle if directions[f] > 0 else low
        right_high = middle if directions[f] < 0 else high
        goes_left = binned[rows, f] <= k
        left = grow(rows[goes_left], level + 1, left_low, left_high)
        right = grow(rows[~goes_left], level + 1, right_low, right_high)
        nodes[me][:4] = [f, cuts[f][k], left, right]
        return me

    both = len(y) and 0 < y.sum() < len(y)
    for _ in range(trees if both else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
        one = flat(nodes, roots[-1:], 0.0, depth)
        margin = margin + one.margin(x)
    return flat(nodes, roots, base if both else 0.0, depth)


def flat(nodes: list[list[float]], roots: list[int], base: float, depth: int) -> Trees:
    table = np.array(nodes, dtype=float).reshape(-1, 5)
    whole = table[:, [0, 2, 3]].astype(np.int64)
    return Trees(whole[:, 0], table[:, 1], whole[:, 1], whole[:, 2], table[:, 4],
                 np.array(roots, dtype=np.int64), base, depth)


def directions() -> np.ndarray:
    return np.array([MONOTONE.get(f, 0) for f in FEATURES])


def featured(sample: DataFrame, target: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, features and targets of a bounded sample, in a fixed order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                _, x = statistics(chunk)
                ends = np.arange(chunk.n + 1, dtype=np.int32) * x.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, chunk.n),
                     pa.ListArray.from_arrays(ends, pa.array(x.ravel())),
                     batch.column(2).slice(chunk.first, chunk.n)], names=["doc_id", "x", "y"])

    rows = (sample.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), target)
            .mapInArrow(run, "doc_id long, x array<double>, y int").toArrow())
    ids = rows["doc_id"].to_numpy()
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    y = rows["y"].to_numpy()
    order = np.lexsort((y, x[:, 0], ids))
    return ids[order], x[order], (y[order] > 0).astype(float)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on at most ``rows`` labelled documents."""
    _, x, y = featured(labelled_sample(docs, labels, [target], rows), target)
    return fit_trees(x, y, directions())


def judge(docs: DataFrame, model: Trees) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and ``score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                counts, x = statistics(chunk)
                words, repeat = counts["n_words"], counts["n_repeat_words"]
                failed = (words < 50) | (100 * repeat > 50 * words)
                score = trees.probability(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, chunk.n),
                     *[pa.array(counts[c].astype(np.int64)) for c in COUNTS], pa.array(failed),
                     pa.array(~failed & (score >= 0.5)), pa.array(score)],
                    names=["doc_id", *COUNTS, "base_failed", "kept", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
        + ", base_failed boolean, kept boolean, score double")
