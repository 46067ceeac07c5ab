"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

A text becomes a sparse row of hashed n-grams: its words and word pairs, the shapes of its words (runs of small
letters, capitals, digits and each other sign) and pairs of shapes, and a mark for each word that repeats the
one before it. The model is fitted by FTRL-Proximal steps over a bounded sample of labelled rows and scored as
sparse dot products over whole batches. Only the text is an input.

Defined results: null and empty texts score as the intercept says; without labels every score is 0.5;
repeated rows score alike; rows without an id count as not held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.linear import Row, fit_ftrl, squash
from opsloom.llm.samples import labelled_sample, text_remainder
from opsloom.llm.tokens import CODES, U64, Chunk, chunks, mix, runs_of

SAMPLE_ROWS = 8_000
BITS = 18

# Byte classes: small letters and all non-ASCII, capitals, digits; other signs stand for themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")


def shapes(chunk: Chunk) -> np.ndarray:
    """A hash of each word's shape: its byte classes with runs of one class folded."""
    kind = _CLASS[chunk.data]
    keep = np.ones(len(kind), dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=keep[1:])
    keep[chunk.starts] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    return Chunk.ranges(CODES[kind[keep]], at[chunk.starts], at[chunk.ends])


def hashed_ngrams(chunk: Chunk, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all n-grams of a chunk and the text each belongs to."""
    words, forms, texts = chunk.hashes(), shapes(chunk), chunk.text_of_word()
    found, owners = [words, mix(forms ^ U64(0x51))], [texts, texts]
    if len(words) > 1:
        pair = texts[1:] == texts[:-1]
        same = pair & (words[1:] == words[:-1])
        found += [runs_of(words, 2)[pair], runs_of(forms, 2, 7)[pair],
                  np.full(np.count_nonzero(same), U64(0x5A4E)) * U64(0x9E3779B97F4A7C15)]
        owners += [texts[1:][pair], texts[1:][pair], texts[1:][same]]
    return (np.concatenate(found) >> U64(64 - bits)).astype(np.int64), np.concatenate(owners)


def weight(chunk: Chunk) -> np.ndarray:
    """What one occurrence counts in each text, so that long and short texts compare."""
    return 1 / np.maximum(chunk.counts, 1)


def sample_rows(sample: DataFrame, target: str, bits: int) -> tuple[list[Row], np.ndarray]:
    """Features and targets of a bounded sample, in an order by hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                feature, owner = hashed_ngrams(chunk, bits)
                key, times = np.unique((owner << bits) | feature, return_counts=True)
                ends = np.searchsorted(key >> bits, np.arange(chunk.n + 1)).astype(np.int32)
                value = np.sqrt(times * weight(chunk)[key >> bits]).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, chunk.n),
                     pa.ListArray.from_arrays(ends, pa.array((key & ((1 << bits) - 1)).astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(value)),
                     batch.column(2).slice(chunk.first, chunk.n)], names=["doc_id", "i", "x", "y"])

    rows = (sample.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), target)
            .mapInArrow(run, "doc_id long, i array<int>, x array<float>, y int").toArrow())
    ids, y = rows["doc_id"].to_numpy(), rows["y"].to_numpy()
    at, val = rows["i"].combine_chunks(), rows["x"].combine_chunks()
    order = np.lexsort((y, ids, mix(ids.astype(np.int64).view(U64))))
    return ([(at[int(k)].values.to_numpy(), val[int(k)].values.to_numpy()) for k in order],
            (y[order] > 0).astype(float))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = SAMPLE_ROWS,
        bits: int = BITS) -> np.ndarray:
    """Weights fitted on at most ``rows`` labelled documents that are not held out."""
    known = labels.where(text_remainder("doc_id", 3) != 1)
    found, targets = sample_rows(labelled_sample(docs, known, [target], rows), target, bits)
    return fit_ftrl(found, targets, 1 << bits)


def scores(chunk: Chunk, weights: np.ndarray, bits: int) -> np.ndarray:
    """Probability for each text of a chunk."""
    feature, owner = hashed_ngrams(chunk, bits)
    key, times = np.unique((owner << bits) | feature, return_counts=True)
    owner = key >> bits
    value = weights[key & ((1 << bits) - 1)] * np.sqrt(times * weight(chunk)[owner])
    margin = np.bincount(owner, value, minlength=chunk.n) + weights[-1]
    return squash(margin)


def classify(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, chunk.n),
                     pa.array(scores(chunk, shared.value, bits))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double")
    return scored.select("doc_id", (text_remainder("doc_id", 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
