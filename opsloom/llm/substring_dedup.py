"""Substring dedup on sliding sentence spans.

A text is cut into sentences: after a word ending in ``. ! ?``, at line ends, and after words that a fixed rule on
their hash picks (about one in ``CUT_EVERY``), so endless sentences have places to cut that depend on the words
alone and a passage has the same inner cuts wherever it stands. From every sentence a span runs over at least
``SENTENCES`` sentences and ``WORDS`` words; its words are hashed. Spans met twice or more anywhere are repeated;
the first of them, by ``doc_id`` and place, stays, and sentences covered by any other one are removed.

Passages need no cuts to be found: of all runs of ``WORDS`` words those with the least hash among ``GAP`` neighbours
are anchors (winnowing), so every repeat of ``WORDS + GAP - 1`` words has an anchor, the same one in each place, and
neighbouring anchors overlap. Where two or more neighbouring anchors repeat, the runs of words up to ``GAP - 1``
before and after them are counted too, so a passage of ``WORDS + 2 * GAP - 1`` words goes to its first and last word.
Words covered by a repeated run that is not the first of its kind are removed, also from within a sentence.

How it runs. Spans are counted by hash alone, with partial aggregation. A bitmap of bounded size, made of the
repeated hashes and sized by their number, then lets a second pass over the texts leave out almost all other spans.
What is left is dealt by hash and sorted; where a hash occurs once it is its own first and stays. So what is
shuffled besides texts follows the amount of repetition, and a passage in a third of all texts costs a row for
each of them, which one task passes over without holding them. The runs at the ends of
repeated anchors set a second bitmap, by which the same pass finds them also inside longer repeats.

Defined results: null and empty texts stay and lose nothing; texts of fewer words than a span
stay; ``n_removed`` counts the sentences under sentence spans, ``removed`` has all ranges; rows without an id stay and take no part; rows that repeat a ``doc_id`` are told apart by their words,
and equal ones count as one; ties can't occur besides; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.tokens import CONTINUES, U64, Chunk, as_long, chunks, mix, random_words
from opsloom.session import cut

SENTENCES = 3
WORDS = 16
CUT_EVERY = 10
GAP = 12             # of so many neighbouring runs of WORDS words one at least is an anchor
BITMAP_BITS = 28     # most bits of a bitmap, 32 MB
KEY_BITS = 64        # bits for each key, as long as there are fewer in all

RUN = random_words(1, 43)[0]     # tells runs of words from sentence spans of the same words

_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True


def sentences(chunk: Chunk, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word offsets of sentence starts, with one closing offset, and the sentence offsets of each text."""
    n = len(hashes)
    if not n:
        return np.zeros(1, dtype=np.int64), np.zeros(chunk.n + 1, dtype=np.int64)
    ends = _STOP[chunk.data[chunk.ends - 1]] | (hashes % U64(CUT_EVERY) == 0)
    if n > 1:
        lines = np.concatenate(([0], np.cumsum(chunk.data == 10)))
        ends[:-1] |= lines[chunk.starts[1:]] > lines[chunk.ends[:-1]]
    last = chunk.bounds[1:][chunk.counts > 0] - 1
    ends[last] = True
    starts = np.concatenate(([0], np.flatnonzero(ends) + 1))
    return starts, np.searchsorted(starts, chunk.bounds)


def spans(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, first sentence (within its text) and sentence count of every span."""
    hashes = chunk.hashes()
    starts, bounds = sentences(chunk, hashes)
    first = np.arange(len(starts) - 1)
    if not len(first):
        none = np.zeros(0, dtype=np.int64)
        return none.view(U64), none, none, none
    text = np.repeat(np.arange(chunk.n), np.diff(bounds))
    stop = np.maximum(first + SENTENCES, np.searchsorted(starts, starts[:-1] + WORDS))
    good = stop <= bounds[text + 1]
    first, stop, text = first[good], stop[good], text[good]
    keys = Chunk.ranges(hashes, starts[first], starts[stop])
    return keys, text, first - bounds[text], stop - first


def slide(best, x: np.ndarray, k: int) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``k`` neighbours."""
    done = 1
    while done < k:
        step = min(done, k - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def word_runs(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every run of ``WORDS`` words, whether it lies in one text, and the places of the anchors."""
    hashes = chunk.hashes()
    at = np.arange(len(hashes) - WORDS + 1)
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none.view(U64), none.astype(bool), none
    keys = mix(Chunk.ranges(hashes, at, at + WORDS) ^ RUN)
    text = chunk.text_of_word()
    good = text[:len(at)] == text[WORDS - 1:]
    # runs across texts never win; there are WORDS - 1 >= GAP of them, so no window sees two texts
    none = np.full(GAP - 1, ~U64(0))
    low = slide(np.minimum, np.concatenate((none, np.where(good, keys, ~U64(0)), none)), GAP)
    return keys, good, np.flatnonzero(good & (slide(np.maximum, low, GAP) == keys))


def is_set(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys >> U64(64 - (64 * len(bits)).bit_length() + 1)
    return (bits[place >> U64(6)] >> (place & U64(63))) & U64(1) == 1


def stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of every two or more anchors with no greater distance than ``GAP``."""
    apart = np.diff(at) > GAP
    first = np.flatnonzero(np.concatenate(([True], apart))) if len(at) else at
    last = np.flatnonzero(np.concatenate((apart, [True]))) if len(at) else at
    two = last > first
    return at[first[two]], at[last[two]]


def tags(chunk: Chunk) -> np.ndarray:
    """31 bits that tell texts with one id apart."""
    total = np.zeros(len(chunk.starts) + 1, dtype=U64)
    hashes = chunk.hashes()
    with np.errstate(over="ignore"):
        np.cumsum(mix(hashes + np.arange(len(hashes), dtype=U64) - np.repeat(
            chunk.bounds[:-1], chunk.counts).astype(U64)), out=total[1:])
        return (mix(total[chunk.bounds[1:]] - total[chunk.bounds[:-1]]) >> U64(33)).astype(np.int64)


def span_keys(docs: DataFrame) -> DataFrame:
    """``key`` of every span and anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                keys, _, at = word_runs(chunk)
                yield pa.RecordBatch.from_arrays([as_long(np.concatenate((spans(chunk)[0], keys[at])))], names=["key"])

    return docs.where("doc_id IS NOT NULL").select(F.col("text").cast("string")).mapInArrow(run, "key long")


def key_bitmap(keys: DataFrame, expected: int | None = None) -> np.ndarray:
    """Bits with those of the keys set: ``KEY_BITS`` for each expected key, ``2 ** BITMAP_BITS`` at most.

    The number of words that arrive is bounded.
    """
    bits = BITMAP_BITS if expected is None else min(BITMAP_BITS, max(20, (KEY_BITS * expected).bit_length()))
    place = F.shiftrightunsigned("key", 64 - bits)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 AS int))")
    words = (keys.select(F.shiftright(place, 6).alias("word"), bit.alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(1 << (bits - 6), dtype=U64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(U64)
    return out


def edge_keys(docs: DataFrame, bitmap) -> DataFrame:
    """``key`` of the runs of words just before and after stretches of anchors whose bits are set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                keys, good, at = word_runs(chunk)
                first, last = stretches(at[is_set(bitmap.value, keys[at])])
                near = np.arange(1, GAP)
                edge = np.concatenate(((first[:, None] - near).ravel(), (last[:, None] + near).ravel()))
                edge = np.unique(edge[(edge >= 0) & (edge < len(keys))])
                yield pa.RecordBatch.from_arrays([as_long(keys[edge[good[edge]]])], names=["key"])

    return docs.where("doc_id IS NOT NULL").select(F.col("text").cast("string")).mapInArrow(run, "key long")


def marked_spans(docs: DataFrame, bitmap, edges) -> DataFrame:
    """``key, doc_id, at, size`` of the spans, anchors and edges whose bit is set.

    ``at`` holds the text's tag and first sentence, or first word where ``size`` is 0 (anchor) or -1 (edge).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                keys, text, first, size = spans(chunk)
                hit = is_set(bits, keys)
                keys, text, first, size = keys[hit], text[hit], first[hit], size[hit]
                runs, good, at = word_runs(chunk)
                at = at[is_set(bits, runs[at])]
                low, high = stretches(at)
                inside = np.zeros(len(runs) + 1, dtype=np.int64)
                np.add.at(inside, np.maximum(low - GAP + 1, 0), 1)
                np.add.at(inside, np.minimum(high + GAP, len(runs)), -1)
                edge = np.flatnonzero((np.cumsum(inside[:-1]) > 0) & good)
                edge = edge[is_set(edges.value, runs[edge])]
                at = np.setdiff1d(at, edge, assume_unique=True)
                word = np.concatenate((at, edge))
                of = chunk.text_of_word()[word]
                keys, text = np.concatenate((keys, runs[word])), np.concatenate((text, of))
                first = np.concatenate((first, word - chunk.bounds[of]))
                size = np.concatenate((size, np.zeros(len(at), dtype=np.int64), np.full(len(edge), -1)))
                if len(keys):
                    ids = batch.column(0).slice(chunk.first, chunk.n).take(pa.array(text))
                    yield pa.RecordBatch.from_arrays(
                        [as_long(keys), ids, pa.array((tags(chunk)[text] << 32) | first), pa.array(size)],
                        names=["key", "doc_id", "at", "size"])

    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "key long, doc_id long, at long, size long")


def but_the_first(rows: DataFrame) -> DataFrame:
    """``doc_id, at, size`` of the rows whose key occurs before them, by ``doc_id`` and place.

    Rows are dealt by key and sorted, so a task passes over them once and holds the first row of one key only,
    however many rows the key has.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                              # key, doc_id and place of the first row of the key at hand
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            new = np.append(True, x[1:, 0] != x[:-1, 0])
            first = x[np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))]
            if held is not None and held[0] == x[0, 0]:
                first[:np.append(np.flatnonzero(new)[1:], len(x))[0]] = held
            held = first[-1].copy()
            yield batch.select(["doc_id", "at", "size"]).filter(pa.array((x[:, 1:] != first[:, 1:]).any(axis=1)))

    ordered = rows.repartition("key").sortWithinPartitions("key", "doc_id", "at")
    return ordered.mapInArrow(run, "doc_id long, at long, size long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, at, size`` of every repeated span that is not the first of its kind."""
    twice = cut(span_keys(docs).groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
                .select("key"), "twice")
    bitmap = docs.sparkSession.sparkContext.broadcast(key_bitmap(twice, twice.count()))
    edges = docs.sparkSession.sparkContext.broadcast(key_bitmap(edge_keys(docs, bitmap)))
    return but_the_first(marked_spans(docs, bitmap, edges))


def cleaned(chunk: Chunk, i: int, starts: np.ndarray, bounds: np.ndarray, gone: list[tuple[int, int]]):
    """Text ``i`` without the sentences in ``gone``, the removed ranges in code points, and their number."""
    own = starts[bounds[i]:bounds[i + 1] + 1]
    drop = np.zeros(len(own) - 1, dtype=bool)
    for a, n in gone:
        if n > 0:
            drop[a:a + n] = True
    low, high = chunk.offsets[i], chunk.offsets[i + 1]
    # a sentence takes the blanks after it along
    edges = np.append(chunk.starts[own[:-1]], high) - low
    edges[0] = 0 if drop[0] and drop.all() else edges[0]
    raw = chunk.data[low:high]
    keep = np.ones(len(raw), dtype=bool)
    for k in np.flatnonzero(drop):
        keep[edges[k]:edges[k + 1]] = False
    words = np.append(chunk.starts[chunk.bounds[i]:chunk.bounds[i + 1]], high) - low
    for a, n in gone:
        if n <= 0:
            keep[words[a]:words[a + WORDS]] = False
    if not keep[words[0]:].any():
        keep[:] = False
    points = np.concatenate(([0], np.cumsum(~CONTINUES[raw])))
    change = np.flatnonzero(np.diff(np.concatenate(([1], keep, [1]))))
    ranges = [{"start": int(points[a]), "end": int(points[b])} for a, b in change.reshape(-1, 2)]
    return raw[keep].tobytes().decode(), ranges, int(drop.sum())


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text, n_sentences, n_removed, removed`` for every row of ``docs``.

    ``text`` lacks the removed sentences and passages; ``removed`` has their ranges in code points of the old text.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    gone = repeated_spans(docs).groupBy("doc_id").agg(F.collect_list(F.struct("at", "size")).alias("gone"))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_sentences", pa.int64()),
                        ("n_removed", pa.int64()),
                        ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(2)
            for chunk in chunks(batch.column(1)):
                starts, bounds = sentences(chunk, chunk.hashes())
                here = slice(chunk.first, chunk.first + chunk.n)
                texts = batch.column(1)[here]
                count, removed = np.zeros(chunk.n, dtype=np.int64), [[] for _ in range(chunk.n)]
                hit = [i for i in range(chunk.n) if marks[chunk.first + i].is_valid]
                if hit:
                    tag, texts = tags(chunk), texts.to_pylist()
                    for i in hit:
                        mine = [(m["at"] & 0xFFFFFFFF, m["size"]) for m in marks[chunk.first + i].as_py()
                                if m["at"] >> 32 == tag[i]]
                        if mine:
                            texts[i], removed[i], count[i] = cleaned(chunk, i, starts, bounds, mine)
                    texts = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[here], texts.cast(pa.string()), pa.array(np.diff(bounds)), pa.array(count),
                     pa.array(removed, schema.field("removed").type)], schema=schema)

    return docs.join(gone, "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(
        run, "doc_id long, text string, n_sentences long, n_removed long, "
             "removed array<struct<start:long,end:long>>")
