"""Benchmark decontamination on templates: also re-parameterised questions are found.

Words become a template: numbers, units and names turn into typed placeholders, other words into their small
letters without signs around them. Windows of ``WINDOW`` template words that hold at least ``LITERALS`` plain
words are hashed; windows of documents meet windows of benchmark items in a hash join. Matches of one document and
item at one distance form an alignment. Numbers and units may change freely in it. A name stands for the name that
takes its place in most of its places, and the other way round; a window counts if each of its names is unchanged or
stands for its own, as when a question is asked with other numbers and names. A document is contaminated by an
item if such windows are at least ``share`` of its windows.

Beside the templates, windows of ``WINDOW`` plain small words are hashed and joined the same way, of shorter items the
whole item; one of fewer than ``ALONE`` words must be a sentence or line of the document by itself, since such words stand
in many texts that have nothing to do with it. Here a document is contaminated by ``share`` of the windows or by ``RUN`` words of the item in a row, so an
excerpt of a long item, an item of few words and a copy in other letter case are found too.

Before the join a bitmap of fixed size, set from all benchmark windows, keeps windows of documents that can't match
from being made into rows. However large the benchmark, the bitmap's size stays; it only lets more rows through.

Defined results: null and empty texts match nothing; rows without an id
are taken together; repeated rows count as one document or item; empty tables give an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.tokens import LOWER_CODES, U64, Chunk, as_long, chunks, mix, random_words, runs_of

WINDOW = 8
LITERALS = 5
SHARE = 0.3
ALONE = 4            # items of fewer words only count where they are a whole sentence or line
RUN = 13             # so many words in a row contaminate, however long the item
BITMAP_BITS = 24     # 2 MB

# Measuring units and number words that fill a slot.
UNITS = ("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer "
         "kilometers g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ml cl l liter liters "
         "litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year "
         "years dollar dollars cent cents euro euros percent degree degrees").split()
NUMBER_WORDS = ("zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
                "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand "
                "million half twice").split()
NUMBER, UNIT, NAME = random_words(3, 41)

_SIGN = np.zeros(256, dtype=bool)
_SIGN[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_SMALL = np.zeros(256, dtype=bool)
_SMALL[97:123] = True
_SMALL[128:] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?:")] = True


def word_hashes(words: list[str]) -> np.ndarray:
    return np.sort(np.concatenate([c.hashes() for c in chunks(pa.array([" ".join(words)]))]))


_UNITS, _NUMBER_WORDS = word_hashes(UNITS), word_hashes(NUMBER_WORDS)


def bare(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words without the signs around them; empty where a word is signs only."""
    starts, ends = chunk.starts.copy(), chunk.ends.copy()
    live = np.flatnonzero(_SIGN[chunk.data[starts]]) if len(starts) else starts
    while len(live):
        starts[live] += 1
        live = live[starts[live] < ends[live]]
        live = live[_SIGN[chunk.data[starts[live]]]]
    live = np.flatnonzero((starts < ends) & _SIGN[chunk.data[ends - 1]]) if len(ends) else ends
    while len(live):
        ends[live] -= 1
        live = live[_SIGN[chunk.data[ends[live] - 1]]]
    return starts, ends


def templates(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template words of a chunk: hash, whether it is a slot, the hash of the word itself, its text, and whether a
    text, line or sentence begins with it."""
    starts, ends = bare(chunk)
    texts = chunk.text_of_word()
    data = chunk.data
    opens = np.ones(len(starts), dtype=bool)     # first word of a text, line or sentence
    if len(starts) > 1:
        lines = np.concatenate(([0], np.cumsum(data == 10)))
        opens[1:] = ((texts[1:] != texts[:-1]) | _STOP[data[chunk.ends[:-1] - 1]]
                     | (lines[chunk.starts[1:]] > lines[chunk.ends[:-1]]))
    own = Chunk.ranges(LOWER_CODES[data], starts, ends)
    solid = starts < ends
    begun = np.concatenate(([0], np.cumsum(opens)))     # a word of signs only leaves its beginning to the next one
    places = np.flatnonzero(solid)
    opens = begun[places + 1] > begun[np.concatenate(([0], places[:-1] + 1))] if len(places) else opens[:0]
    starts, ends, texts, own = (x[solid] for x in (starts, ends, texts, own))
    small = np.concatenate(([0], np.cumsum(_SMALL[data] | _UPPER[data])))
    number = _DIGIT[data[starts]] & (small[ends] - small[starts] <= 3) | np.isin(own, _NUMBER_WORDS)
    unit = np.isin(own, _UNITS)
    second = np.minimum(starts + 1, ends - 1)
    name = _UPPER[data[starts]] & _SMALL[data[second]] & ~opens
    out = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, own)))
    return out, number | unit | name, own, texts, opens


def template_windows(rows: DataFrame, ident: str, bitmap=None, window: int = WINDOW,
                     literals: int = LITERALS) -> DataFrame:
    """``ident, at, window, slots, places, windows``: each window's place, hash and slots, and how many its text has.

    ``slots`` has the values, ``places`` twice their offset in the window, plus 1 for a name.

    With a broadcast ``bitmap`` only the windows whose bit is set become rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else bitmap.value
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                words, slot, own, texts, _ = templates(chunk)
                name = words == NAME
                n = len(words) - window + 1
                if n <= 0:
                    continue
                plain = np.concatenate(([0], np.cumsum(~slot)))
                good = (texts[:n] == texts[window - 1:]) & (plain[window:] - plain[:n] >= literals)
                hashes = runs_of(words, window)
                per_text = np.bincount(texts[:n][good], minlength=chunk.n)
                if bits is not None:
                    place = hashes >> U64(64 - BITMAP_BITS)
                    good &= (bits[place >> U64(6)] >> (place & U64(63))) & U64(1) == 1
                at = np.flatnonzero(good)
                if not len(at):
                    continue
                first = np.searchsorted(texts, np.arange(chunk.n))
                text = texts[at]
                values = [own[i:i + window][slot[i:i + window]] for i in at]
                places = [np.flatnonzero(slot[i:i + window]) * 2 + name[i:i + window][slot[i:i + window]] for i in at]
                ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, chunk.n).take(pa.array(text)),
                     pa.array(at - first[text]), as_long(hashes[at]),
                     pa.ListArray.from_arrays(ends, as_long(np.concatenate(values))),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(places))),
                     pa.array(per_text[text])], names=[ident, "at", "window", "slots", "places", "windows"])

    return rows.select(F.col(ident).cast("long"), F.col("text").cast("string")).mapInArrow(
        run, f"{ident} long, at long, window long, slots array<long>, places array<long>, windows long")


def plain_windows(rows: DataFrame, ident: str, sizes: list[int], bitmap=None) -> DataFrame:
    """``ident, at, window, words``: each plain window's place and hash, and how many words its text has.

    Without a broadcast ``bitmap`` windows shorter than ``WINDOW`` are whole texts only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                _, _, own, texts, opens = templates(chunk)
                opens = np.append(opens, True)
                words = np.bincount(texts, minlength=chunk.n)
                first = np.searchsorted(texts, np.arange(chunk.n))
                for size in sizes:
                    hashes = runs_of(own, size, 50 + size)
                    good = texts[:len(hashes)] == texts[size - 1:] if len(hashes) else np.zeros(0, dtype=bool)
                    if bitmap is not None:
                        place = hashes >> U64(64 - BITMAP_BITS)
                        good &= (bitmap.value[place >> U64(6)] >> (place & U64(63))) & U64(1) == 1
                        if size < ALONE:
                            good &= opens[:len(hashes)] & opens[size:size + len(hashes)]
                    elif size < WINDOW:
                        good &= words[texts[:len(hashes)]] == size
                    at = np.flatnonzero(good)
                    text = texts[at]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(chunk.first, chunk.n).take(pa.array(text)), pa.array(at - first[text]),
                         as_long(hashes[at]), pa.array(words[text])], names=[ident, "at", "window", "words"])

    return rows.select(F.col(ident).cast("long"), F.lower(F.col("text").cast("string"))).mapInArrow(
        run, f"{ident} long, at long, window long, words long")


def plain_leaks(docs: DataFrame, benchmark: DataFrame, share: float) -> DataFrame:
    """Pairs found on plain windows: ``doc_id, item_id, matched, item_windows, exact``."""
    items = plain_windows(benchmark, "item_id", list(range(1, WINDOW + 1))).distinct()
    sizes = [r[0] for r in items.select(F.least("words", F.lit(WINDOW))).distinct().collect()]
    bitmap = docs.sparkSession.sparkContext.broadcast(window_bitmap(items))
    found = plain_windows(docs, "doc_id", sizes, bitmap).select("doc_id", "window", F.col("at").alias("doc_at"))
    need = F.greatest(F.least("words", F.lit(RUN)) - (WINDOW - 1), F.lit(1)).cast("int")
    windows = F.greatest(F.col("words") - (WINDOW - 1), F.lit(1))
    return (found.join(items, "window")
            .groupBy("doc_id", "item_id", "words", (F.col("doc_at") - F.col("at")).alias("shift"))
            .agg(F.array_sort(F.collect_set("at")).alias("ats"))
            .withColumn("need", need)
            .withColumn("run", F.expr("size(ats) >= need AND exists(sequence(1, greatest(size(ats) - need + 1, 1)), "
                                      "i -> try_element_at(ats, i + need - 1) - ats[i - 1] = need - 1)"))
            .groupBy("doc_id", "item_id", "words")
            .agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).cast("long").alias("matched"),
                 F.max("run").alias("run"))
            .where(F.col("run") | (F.col("matched") >= F.greatest(share * windows, F.lit(1.0))))
            .select("doc_id", "item_id", "matched", windows.alias("item_windows"), F.lit(True).alias("exact")))


def window_bitmap(windows: DataFrame) -> np.ndarray:
    """``2 ** BITMAP_BITS`` bits with those of the windows' hashes set; at most that many arrive here."""
    place = F.shiftrightunsigned("window", 64 - BITMAP_BITS)
    words = (windows.select(F.shiftright(place, 6).alias("word"),
                            F.expr(f"shiftleft(1L, cast(shiftrightunsigned(window, {64 - BITMAP_BITS}) & 63 AS int))")
                            .alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype=U64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(U64)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """Contaminated pairs: ``doc_id, item_id, matched, item_windows, exact``.

    ``matched`` counts the item's windows found with consistent slots; ``exact`` says that all slots have the
    item's own values. Pairs found on plain windows only have the numbers of those.
    """
    items = template_windows(benchmark, "item_id").dropDuplicates(["item_id", "at", "window"])
    bitmap = docs.sparkSession.sparkContext.broadcast(window_bitmap(items))
    found = template_windows(docs, "doc_id", bitmap).select(
        "doc_id", "window", F.col("at").alias("doc_at"), F.col("slots").alias("doc_slots"))
    hits = found.join(items, "window").select(
        "doc_id", "item_id", "at", "windows", (F.col("doc_at") - F.col("at")).alias("shift"),
        F.transform(F.arrays_zip(F.col("slots").alias("i"), F.col("doc_slots").alias("d"), F.col("places").alias("p")),
                    lambda s: F.struct(s["i"].alias("i"), s["d"].alias("d"), (s["p"] % 2 == 1).alias("name"),
                                       (F.col("at") + F.floor(s["p"] / 2)).alias("place"))).alias("pairs"))

    def own(pair):
        """Most places of either name have this pair."""
        same = F.size(F.filter("names", lambda n: n["i"] == pair["i"]))
        back = F.size(F.filter("names", lambda n: n["d"] == pair["d"]))
        both = F.size(F.filter("names", lambda n: (n["i"] == pair["i"]) & (n["d"] == pair["d"])))
        return 2 * both > F.greatest(same, back)

    pairs = F.array_distinct(F.flatten(F.collect_set("pairs")))
    aligned = (hits.groupBy("doc_id", "item_id", "windows", "shift")
               .agg(F.filter(pairs, lambda p: p["name"]).alias("names"), F.collect_set(F.struct("at", "pairs")).alias("all"))
               .withColumn("clash", F.transform(F.filter("names", lambda p: (p["i"] != p["d"]) & ~own(p)),
                                                lambda p: p["place"]))
               .withColumn("all", F.filter("all", lambda w: ~F.exists(w["pairs"], lambda p: p["name"] & (
                   p["i"] != p["d"]) & F.array_contains("clash", p["place"]))))
               .where(F.size("all") > 0)
               .select("doc_id", "item_id", "windows", F.transform("all", lambda w: w["at"]).alias("ats"),
                       F.forall("all", lambda w: F.forall(w["pairs"], lambda p: p["i"] == p["d"])).alias("exact")))
    typed = (aligned.groupBy("doc_id", "item_id", "windows")
             .agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).cast("long").alias("matched"),
                  F.bool_and("exact").alias("exact"))
             .where(F.col("matched") >= F.greatest(F.lit(share) * F.col("windows"), F.lit(1.0)))
             .select("doc_id", "item_id", "matched", F.col("windows").alias("item_windows"), "exact"))
    values = ["matched", "item_windows", "exact"]
    return (typed.withColumn("typed", F.lit(1))
            .unionByName(plain_leaks(docs, benchmark, share).withColumn("typed", F.lit(0)))
            .groupBy("doc_id", "item_id").agg(F.max(F.struct("typed", *values)).alias("best"))
            .select("doc_id", "item_id", *[f"best.{v}" for v in values]))


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """``docs`` without the documents that a benchmark item contaminates; rows without an id stay."""
    bad = leaks(docs, benchmark, share).where("doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
