"""Which tokens of one tokenizer meet which tokens of another, per document and counted over the corpus.

Two tokenizers cut the same bytes, a blank and the text, in their own way. Byte offsets where tokens of both end are
shared cuts; between neighbouring cuts lies a group of tokens of each. They are found by dividing: an interval between
two cuts looks for a further one near its middle, by bisecting the second tokenizer's ends for one end after the other
of the first, outwards from the middle; where it finds one it goes on with both halves, and an interval without a cut is
a group. All intervals of one depth are divided together.

A blank after a character that is no white space begins a token of either tokenizer, so the division starts from there,
and a word is tokenized and divided once for all its places in a block of texts. This holds for byte-level vocabularies,
and for pieces if none has a blank behind another character; a piece vocabulary that has one is given whole texts.

A block of some megabytes becomes one row in the shared folder: figures of its documents, its distinct id pairs with the
number of documents that hold them, and which document holds which pair how often. Pairs are summed over blocks, the
best count of each first id is taken, and each block gets the counts of its own pairs back. A pair is one row per
block however frequent it is, and copies of a document fall together in their block.

Results for odd input: texts that are null or empty, or that a tokenizer can't give back byte by byte, have no tokens:
zeros, and '' for the hash. Every row counts as a document, repeated rows and ids too; a null id stays null. Empty
tables give an empty result. Other columns are not read. A text longer than a block is a block of its own, so memory
follows the longest text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsloom.llm.packing import pack_planes, unpack_planes
from opsloom.llm.token_counts import byte_letters
from opsloom.session import cut

BLOCK_CHARS = 2_000_000        # characters of a block
TOGETHER = 2_000               # words that are tokenized as one text
# Fixed value: how byte-level vocabularies split a text before merging.
_PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FIGURES = ("n_a", "n_b", "n_groups", "n_links")
_BLANK = re.compile(r"(?<=\S) (?=\S)")
_UNEVEN = re.compile(r"^ |\s | $")


def divide(a: np.ndarray, b: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which ends of ``a`` are ends of ``b`` too, as sorted places in ``a``, each counted as the ends up to it.

    ``a`` and ``b`` are rising byte offsets; ``bounds`` are places known to be cuts, the first 0, the last ``len(a)``.
    """
    cuts = [bounds]
    low, high = bounds[:-1], bounds[1:]
    while True:
        open_ = high - low > 1
        low, high = low[open_], high[open_]
        if not len(low):
            return np.sort(np.concatenate(cuts))
        middle, found, left, away = (low + high) // 2, np.zeros_like(low), np.arange(len(low)), 0
        while len(left):
            for side in (away, -away) if away else (0,):
                at = middle[left] + side
                inside = (at > low[left]) & (at < high[left])
                ends = a[np.where(inside, at, 1) - 1]
                hit = inside & (b[np.minimum(np.searchsorted(b, ends), len(b) - 1)] == ends)
                found[left[hit]] = at[hit]
                left = left[~hit]
            away += 1
            left = left[(middle[left] + away < high[left]) | (middle[left] - away > low[left])]
        own = found > 0
        cuts.append(found[own])
        low, high = np.concatenate([low[own], found[own]]), np.concatenate([found[own], high[own]])


class Pair:
    """Two tokenizers with the bytes of their tokens: byte-level (A) and pieces with byte fallback (B)."""

    def __init__(self, a: bytes, b: bytes):
        of, spec = byte_letters(), json.loads(a)
        names = {bytes(of[c] for c in name): i for name, i in spec["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][x + y] for x, y in merges]
        if made != sorted(made) or spec["normalizer"] or not spec["pre_tokenizer"]["use_regex"]:
            raise ValueError("not a byte-level vocabulary in the order of its merges")
        self.a = tiktoken.Encoding("a", pat_str=_PARTS, mergeable_ranks=names, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a = by_number(names)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)

    def words(self, text: str) -> list[str]:
        """The text in parts that are tokenized by themselves, each without the blank before it."""
        if not self.by_word:
            return [text]
        return _BLANK.split(text) if _UNEVEN.search(text) else text.split(" ")

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of both tokenizers for a blank and the text, and whether both give its bytes back."""
        raw, b = (" " + text).encode(), self.b.encode(text)
        a = self.a.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
        good = raw == b"".join(map(self.bytes_a.__getitem__, a.tolist())) == b"".join(map(self.bytes_b.__getitem__, b))
        return (a, np.array(b, np.int64), True) if good else (a[:0], a[:0], False)

    def align(self, words: list[str]) -> Words:
        """Tokens, groups and links of words, each one with a blank before it.

        Many words are tokenized as one text; one that a tokenizer can't give back, or that ends with white space, which
        could grow together with the blank of the next, is tokenized by itself.
        """
        good, a, b, at = np.ones(len(words), bool), [], [], 0
        while at < len(words):
            to = at + 1
            if self.by_word and not words[at][-1:].isspace() and words[at]:
                while to < min(len(words), at + TOGETHER) and words[to] and not words[to][-1].isspace():
                    to += 1
            x, y, whole = self.tokens(" ".join(words[at:to]))
            if whole or to == at + 1:
                good[at:to] = whole
                a.append(x), b.append(y)
            else:
                for i in range(at, to):
                    x, y, good[i] = self.tokens(words[i])
                    a.append(x), b.append(y)
            at = to
        size = np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words)) * good
        return Words(self, good, size, *(np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b)))


def by_number(names: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        out[i] = name
    return out


def digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers below ``n`` as text in bytes, filled up with zeros, and how many bytes each has."""
    texts = np.array([str(i).encode() for i in range(n)])
    return texts.view(np.uint8).reshape(n, -1), np.char.str_len(texts)


class Words:
    """Aligned words: ``n_a, n_b, n_groups, n_links`` of each, its groups as text, and its id pairs.

    ``size`` has the bytes of each word, 0 if it has no tokens; ``a`` and ``b`` are the ids of all words.
    """

    def __init__(self, pair: Pair, good: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.good, words = good, len(good)
        stops, ends_a, ends_b = np.cumsum(size), np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
        past_a, past_b = np.searchsorted(ends_a, stops, "right"), np.searchsorted(ends_b, stops, "right")
        bounds = np.concatenate([[0], past_a])
        cuts = divide(ends_a, ends_b, bounds[np.append(True, np.diff(bounds) > 0)])[1:]
        offsets = ends_a[cuts - 1]                                    # byte offsets at which groups end
        ends = np.sort(np.concatenate([ends_a, ends_b]))
        ends = ends[np.append(True, np.diff(ends) > 0)[:len(ends)]]   # where a link ends
        link_a, link_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        of_link = np.searchsorted(stops, ends)
        n_groups, n_links = (np.searchsorted(x, stops, "right") for x in (offsets, ends))
        self.figures = np.diff(np.stack([past_a, past_b, n_groups, n_links]), axis=1, prepend=0).T
        self.text = self.written(a, ends_a, b, ends_b, offsets, past_a + past_b)
        # distinct pairs of each word and how often it links them
        self.pairs, place = np.unique(a[link_a] << 32 | b[link_b], return_inverse=True)
        own, self.times = np.unique(of_link << 32 | place, return_counts=True)
        self.pair, of = own & 0xFFFFFFFF, own >> 32
        self.first = np.searchsorted(of, np.arange(words + 1))

    @staticmethod
    def written(a, ends_a, b, ends_b, offsets, stops) -> list[bytes]:
        """Groups of each word as ``a1,a2|b1;a3|b2,b3;``."""
        if not len(a):
            return [b""] * len(stops)
        group_a, group_b = np.searchsorted(offsets, ends_a), np.searchsorted(offsets, ends_b)
        before = np.concatenate([[0], np.cumsum(np.bincount(group_a, minlength=len(offsets)))])   # of a, by group
        ids, sign = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        for own, ends, group, last, place in (
                (a, ends_a, group_a, b"|", np.arange(len(a)) + np.searchsorted(group_b, group_a)),
                (b, ends_b, group_b, b";", np.arange(len(b)) + before[1:][group_b])):
            ids[place], sign[place] = own, np.where(offsets[group] == ends, ord(last), ord(","))
        table, size = digits(int(ids.max()) + 1)
        cells = np.column_stack([table[ids], np.zeros(len(ids), np.uint8)])
        cells[np.arange(len(ids)), size[ids]] = sign
        text = cells[cells != 0].tobytes()
        at = np.concatenate([[0], np.cumsum(size[ids] + 1)])[np.concatenate([[0], stops])].tolist()
        return [text[x:y] for x, y in zip(at[:-1], at[1:])]


def aligned(pair: Pair, texts: list[str]):
    """Figures and groups of each text, and its id pairs: keys, (text, pair) entries and how often each is linked."""
    numbers: dict[str, int] = defaultdict(lambda: len(numbers))
    held = [[numbers[w] for w in pair.words(t)] if t else [] for t in texts]
    words = pair.align(list(numbers))
    size = np.fromiter(map(len, held), np.int64, len(held))
    of, word = np.repeat(np.arange(len(texts)), size), np.fromiter((w for h in held for w in h), np.int64, size.sum())
    good = (size > 0) & (np.bincount(of[~words.good[word]], minlength=len(texts)) == 0)
    figures = np.zeros((len(texts), len(FIGURES)), np.int64)
    for k in range(len(FIGURES)):
        figures[:, k] = np.bincount(of, words.figures[word, k], len(texts))
    figures[~good] = 0
    groups = [b"".join(map(words.text.__getitem__, h))[:-1] if g else b"" for h, g in zip(held, good.tolist())]
    # how often each text has each word, then each pair of that word
    own, times = np.unique((of << 32 | word)[good[of]], return_counts=True)
    of, word = own >> 32, own & 0xFFFFFFFF
    n = words.first[word + 1] - words.first[word]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - words.first[word], n)
    entries, where = np.unique(np.repeat(of, n) << 32 | words.pair[at], return_inverse=True)
    times = np.bincount(where, np.repeat(times, n) * words.times[at], len(entries)).astype(np.int64)
    used, place = np.unique(entries & 0xFFFFFFFF, return_inverse=True)
    return figures, groups, words.pairs[used], entries >> 32, place, times


_pairs: dict[tuple[bytes, bytes], Pair] = {}


def pair_of(a: bytes, b: bytes) -> Pair:
    """The two tokenizers of this worker process."""
    if (a, b) not in _pairs:
        _pairs.clear()
        _pairs[a, b] = Pair(a, b)
    return _pairs[a, b]


def parts(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of a batch up to a number of characters, each part with its first row."""
    first, own, total = 0, [], 0
    for i, text in enumerate(batch.column(1)):
        text = text.as_py() or ""
        if own and total + len(text) > size:
            yield first, own
            first, own, total = i, [], 0
        own.append(text)
        total += len(text)
    if own:
        yield first, own


def shipped(docs: DataFrame, a: str, b: str):
    """Both vocabularies, a few megabytes of fixed size, for the executors."""
    with open(a, "rb") as one, open(b, "rb") as other:
        return docs.sparkSession.sparkContext.broadcast((one.read(), other.read()))


def token_groups(docs: DataFrame, a: str, b: str, text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups``: the aligned tokens of each text, groups written as
    ``a1,a2|b1;a3|b2,b3``. ``a`` and ``b`` are vocabulary files on the driver."""
    files, kind = shipped(docs, a, b), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in parts(batch, block_chars):
                figures, groups, *_ = aligned(pair_of(*files.value), texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), *map(pa.array, figures.T),
                     pa.array([g.decode() for g in groups], pa.string())],
                    ["doc_id", *FIGURES, "groups"])

    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, {', '.join(f'{f} long' for f in FIGURES)}, groups string")


def blocks(docs: DataFrame, a: str, b: str, text: str, block_chars: int) -> DataFrame:
    """A row for each block: its documents with figures and hash, its id pairs with the number of documents that
    hold them, and packed which document holds which pair how often."""
    files, kind = shipped(docs, a, b), docs.schema["doc_id"].dataType.simpleString()
    columns = ("block long, doc_id array<" + kind + ">, " + ", ".join(f"{f} array<long>" for f in FIGURES)
               + ", groups_sha256 array<string>, pairs array<long>, holders array<long>,"
                 " sizes binary, places binary, times binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for first, texts in parts(batch, block_chars):
                figures, groups, pairs, of, place, times = aligned(pair_of(*files.value), texts)
                hashed = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                step = np.diff(place, prepend=0)
                start = np.append(True, np.diff(of) > 0)[:len(of)]
                step[start] = place[start]                            # a text's places rise, so differences are small
                lists = [batch.column(0).slice(first, len(texts)), *figures.T, hashed, pairs,
                         np.bincount(place, minlength=len(pairs))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([next(number)]),
                     *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else
                                                pa.array(x, pa.string() if x is hashed else pa.int64()))
                       for x in lists],
                     *[pa.array([pack_planes(x, 4)], pa.binary())
                       for x in (np.bincount(of, minlength=len(texts)), step, times)]],
                    [c.split()[0] for c in columns.split(", ")])

    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(run, columns)


def pair_counts(stored: DataFrame) -> DataFrame:
    """``pair, total, best``: documents that hold each id pair, and whether no pair of its first id has more."""
    counts = own_pairs(stored).groupBy("pair").agg(F.sum("n").alias("total"))
    first = Window.partitionBy(F.shiftright("pair", 32))          # at most one row for each id of B
    return counts.withColumn("best", F.col("total") == F.max("total").over(first))


def own_pairs(stored: DataFrame) -> DataFrame:
    return stored.select("block", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("holders").alias("n"))))


def align_tokens(docs: DataFrame, a: str, b: str, text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``n_best`` counts links whose id pair is held by as many documents as any pair of its first id; ``count_sum``
    adds up over all links how many documents hold their pair.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    stored = cut(blocks(docs, a, b, text, block_chars), "aligned")
    answers = (own_pairs(stored).join(pair_counts(stored), "pair").groupBy("block")
               .agg(F.sort_array(F.collect_list(F.struct("pair", "total", "best"))).alias("answer"))
               .select("block", F.col("answer.total").alias("total"), F.col("answer.best").alias("best")))
    figures = [*FIGURES, "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name).slice(i, 1) for name in batch.schema.names}
                size, step, times = (unpack_planes(row[c][0].as_py(), 4).astype(np.int64)
                                     for c in ("sizes", "places", "times"))
                of = np.repeat(np.arange(len(size)), size)
                summed = np.cumsum(step)
                start = np.cumsum(size) - size
                base = np.where(size > 0, (summed - step)[np.minimum(start, max(len(step) - 1, 0))] if len(step) else 0, 0)
                place = summed - base[of]
                total = row["total"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                best = row["best"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sums = np.zeros((2, len(size)), np.int64)
                np.add.at(sums[0], of, times * best[place])
                np.add.at(sums[1], of, times * total[place])
                yield pa.RecordBatch.from_arrays(
                    [row["doc_id"].flatten(), *[row[f].flatten() for f in FIGURES], *map(pa.array, sums),
                     row["groups_sha256"].flatten()], ["doc_id", *figures, "groups_sha256"])

    met = stored.drop("pairs", "holders").join(answers, "block", "left")
    return met.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{f} long' for f in figures)}, groups_sha256 string")
