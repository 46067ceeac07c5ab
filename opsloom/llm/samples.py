"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.tokens import random_words


def text_remainder(column: str, n: int) -> Column:
    """Remainder of the crc32 of a column as text; false ids count as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, targets: list[str], rows: int) -> DataFrame:
    """``doc_id, text`` and the target columns of at most ``rows`` labelled documents.

    Which rows these are depends on a hash of ``doc_id`` only. The chosen labels have at most
    ``rows`` rows of a few numbers, so they can be broadcast at any input size. Rows with a null
    id, text or target and labels of unknown documents don't count.
    """
    chosen = (labels.select("doc_id", *[F.col(t).cast("int") for t in targets]).dropna()
              .orderBy(F.xxhash64("doc_id"), "doc_id", *targets).limit(rows))
    known = docs.select("doc_id", "text").where("text IS NOT NULL")
    return known.join(F.broadcast(chosen), "doc_id")


def fold_of(doc_ids, folds: int):
    """A fold number for each id that does not follow the order of ids."""
    import numpy as np

    from opsloom.llm.tokens import U64, mix
    salt = random_words(1, 77)[0]
    return (mix(np.asarray(doc_ids, dtype=np.int64).view(U64) ^ salt) % U64(folds)).astype(int)
