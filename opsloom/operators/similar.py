"""Similarity joins over texts and 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions import text
from opsloom.operators.graph import components
from opsloom.operators.heavy import SHARE, heavy_keys, split_join
from opsloom.session import cut

EPSILON = 1e-9   # bounds are products of a decimal threshold and must not fall short by rounding


# ---------------------------------------------------------------- near duplicates

# Shingle hashes are numbers below this prime.
PRIME = 2147483647

RUNS = 1 << 16           # runs of words of one text that are strings at a time
RANGE_ITEMS = 1 << 21    # items of a range that are counted together, on the average
BLOCK_SETS = 256         # sets that a block holds on the average, at most
BLOCK_ITEMS = 1 << 18    # items that a block holds on the average, at most
BLOCK_COLUMNS = 4096     # items that one matrix product of a pair of blocks counts


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def rare_items(sets: DataFrame, threshold: float) -> DataFrame:
    """``item, id, n, left, lead``: the items by which sets of the asked Jaccard similarity must meet.

    Items stand in the order of how many sets have them. Similar sets share one of the first
    ``n - threshold * n + 1`` items of both; ``left`` counts the items from here on. Items of one
    set take places but meet nothing. ``lead``, the least item a set shares with any other, is mostly
    the same in near copies.
    """
    ordered = (shared_items(sets).groupBy("id", "n")
               .agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("list"), F.min("item").alias("lead")))
    return (ordered.select("id", "n", F.size("list").alias("m"), "lead", F.posexplode("list"))
            .select(F.col("col.item").alias("item"), "id", "n", (F.col("m") - F.col("pos")).alias("left"), "lead")
            .filter(F.col("left") + EPSILON >= threshold * F.col("n")))


def shared_items(sets: DataFrame) -> DataFrame:
    """``id, n, df, item``: the items that stand in ``df`` sets, two at least.

    Items travel once, in rows that hold a batch's items of one range of hashes, and are counted where a range comes
    together. Ranges hold ``RANGE_ITEMS`` on the average; items with a large share of all are counted by themselves.
    """
    small = sets.select("id", F.col("set").cast("array<int>").alias("set")).filter("set IS NOT NULL")
    kind = dict(sets.dtypes)["id"]
    size = small.agg(F.coalesce(F.sum(F.size("set")), F.lit(0)).alias("items"), F.count(F.lit(1)).alias("sets")).first()
    total, hot = size["items"], []
    if size["sets"] >= SHARE * total:   # an item stands once in a set, so in large sets none has such a share
        hot = [k for k, _ in heavy_keys(small.select(F.explode("set").alias("item")), "item")]
    dealt = small.mapInArrow(into_ranges(max(1, -(-total // RANGE_ITEMS)), hot),
                             f"part int, id array<{kind}>, n array<int>, item array<int>")
    rows = dealt.groupBy("part").applyInArrow(met_twice, f"id {kind}, n int, df long, item int")
    if hot:
        of = small.select("id", F.size("set").alias("n"), F.explode(F.filter("set", lambda x: x.isin(hot))).alias("item"))
        counts = of.groupBy("item").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        rows = rows.unionByName(of.join(F.broadcast(counts), "item"))
    return rows.withColumn("item", F.col("item").cast("long"))


def into_ranges(parts: int, hot: list[int]):
    """For ``mapInArrow`` over ``id, set``: the items of a batch by ranges, without the hot ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b["set"].value_lengths().to_numpy()
            item, row = b["set"].flatten().to_numpy(), np.repeat(np.arange(b.num_rows), lengths)
            if hot:
                cold = ~np.isin(item, hot)
                item, row = item[cold], row[cold]
            part = item % parts
            order = np.argsort(part, kind="stable")
            part, item, row = part[order], item[order], row[order]
            which, begin = np.unique(part, return_index=True)
            ends = pa.array(np.append(begin, len(part)), pa.int32())

            def lists(values):
                return pa.ListArray.from_arrays(ends, values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(which, pa.int32()), lists(b["id"].take(pa.array(row))),
                 lists(pa.array(lengths[row], pa.int32())), lists(pa.array(item, pa.int32()))],
                names=["part", "id", "n", "item"])
    return run


def met_twice(rows: pa.Table) -> pa.Table:
    """The items of one range that stand in two sets at least, a row for each of these."""
    flat = {name: pa.concat_arrays([c.flatten() for c in rows[name].chunks]) for name in ("id", "n", "item")}
    _, which, df = np.unique(flat["item"].to_numpy(), return_inverse=True, return_counts=True)
    df = df[which]
    kept = pa.array(np.flatnonzero(df > 1))
    return pa.table({"id": flat["id"].take(kept), "n": flat["n"].take(kept),
                     "df": pa.array(df, pa.int64()).take(kept), "item": flat["item"].take(kept)})


def shingle_numbers(words: bytes, n: int = 3) -> np.ndarray:
    """The numbers of ``text.hash_number`` of the distinct runs of ``n`` words, below the prime, sorted."""
    w, found = words.split(b" "), []
    for at in range(0, max(len(w) - n + 1, 1), RUNS):
        part = w[at:at + RUNS + n - 1]
        runs = {*map(b" ".join, zip(*(part[i:] for i in range(n))))} or {words}
        heads = b"".join([md5(run).digest()[:4] for run in runs])
        found.append(np.unique(np.frombuffer(heads, ">u4").astype(np.int64) % PRIME))
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: ``id, set`` of ``id, words``; no set without text."""
    for b in batches:
        sets = [None if w is None else shingle_numbers(w) for w in b["words"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["id"], pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])


def folded(docs: DataFrame, key: str, body: str) -> tuple[DataFrame, DataFrame]:
    """Files with the first file of their content, ``_first``, and the written shingle sets of first files.

    A file without text is the first and only one of its kind.
    """
    src = docs.select(key, F.md5(body).alias("_h"), body)
    firsts = src.groupBy("_h").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n"))
    # Only hashes with copies take part, and only ids travel, however popular one content is.
    copied = split_join(src.select(key, "_h"), firsts.filter("_n > 1 AND _h IS NOT NULL").drop("_n"), "_h", "left")
    uniques = src.join(firsts.select(F.col("_first").alias(key)), key, "left_semi")
    worded = uniques.select(F.col(key).alias("id"), F.array_join(text.words(body), " ").cast("binary").alias("words"))
    hashed = cut(worded.mapInArrow(shingle_sets, f"id {dict(worded.dtypes)['id']}, set array<long>"), "sets")
    return copied.select(key, F.coalesce("_first", key).alias("_first")), hashed


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``src, dst, score``: the pairs whose whole sets reach the threshold."""
    scored = split_join(split_join(pairs, sets.toDF("src", "_a"), "src"), sets.toDF("dst", "_b"), "dst")
    return (scored.select("src", "dst", jaccard(F.col("_a"), F.col("_b")).alias("score"))
            .filter(F.col("score") >= threshold))


def reachable(n: Column, n2: Column, left: Column, left2: Column, threshold: float) -> Column:
    """Whether two sets can still overlap enough, by their sizes and what is left of both from a shared item on."""
    overlap = threshold / (1 + threshold) * (n + n2)
    return (F.least(left, left2) + EPSILON >= overlap) & (F.least(n, n2) + EPSILON >= threshold * F.greatest(n, n2))


def related(docs: DataFrame, threshold: float = 0.6, key: str = "file_id",
            body: str = "text") -> DataFrame:
    """RELATED_TO edges (src, dst, score), src < dst, score = exact Jaccard of word 3-grams.

    Exact copies hang on their first file with score 1. Of the first files every pair that reaches
    the threshold is found: they meet by their rarest shingles, early enough in both sets for the
    overlap to be reachable, and are compared on whole sets. Near copies lie in blocks of bounded size; blocks meet
    instead of files, a set travels once to each pair of blocks, and overlaps are matrix products, so a group of many
    near copies costs no row a pair but its edges. ``related_classes`` says the same in one row a file.
    """
    copied, hashed = folded(docs, key, body)
    copies = copied.filter(F.col(key) > F.col("_first")).select(
        F.col("_first").alias("src"), F.col(key).alias("dst"), F.lit(1.0).alias("score"))
    rare = cut(rare_items(hashed, threshold), "rare")
    blocks = cut(blocks_of(rare), "blocks")
    meets = cut(meeting_blocks(rare.join(blocks, "id"), threshold), "meets")
    members = blocks.join(hashed, "id").select("block", "id", F.col("set").cast("array<int>").alias("set"))
    sides = (meets.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
             .join(members, "block").repartition("low", "high").sortWithinPartitions("low", "high"))
    kind = dict(members.dtypes)["id"]
    near = sides.mapInArrow(block_pairs(threshold), f"a {kind}, b {kind}, score double")
    return copies.unionByName(near.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "score"))


def blocks_of(rare: DataFrame) -> DataFrame:
    """``id, block``: sets of one lead, dealt over as many blocks as keep a block small."""
    led = rare.groupBy("id").agg(F.min("lead").alias("lead"), F.max("n").alias("n"))
    parts = led.groupBy("lead").agg(F.ceil(F.greatest(
        F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_ITEMS)).alias("parts"))
    return split_join(led, parts, "lead").select(
        "id", (F.col("lead") * (1 << 31) + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"))


def meeting_blocks(rare: DataFrame, threshold: float) -> DataFrame:
    """``low, high``: the pairs of blocks, or blocks with themselves, in which two sets may be similar.

    Two sets that meet in an item lie in two blocks that meet there; what is true of the largest rest and of the
    sizes of a block bounds each of its sets.
    """
    cells = rare.groupBy("item", "block").agg(
        F.count(F.lit(1)).alias("sets"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("left").alias("left"))
    a, b = cells.alias("a"), cells.alias("b")
    overlap = threshold / (1 + threshold) * (F.col("a.least") + F.col("b.least"))
    return (a.join(b, F.col("a.item") == F.col("b.item"))
            .filter("a.block < b.block OR a.block = b.block AND a.sets > 1")
            .filter(F.least("a.left", "b.left") + EPSILON >= overlap)
            .filter((F.col("a.most") + EPSILON >= threshold * F.col("b.least"))
                    & (F.col("b.most") + EPSILON >= threshold * F.col("a.least")))
            .select(F.col("a.block").alias("low"), F.col("b.block").alias("high")).distinct())


def overlaps(sets: list[np.ndarray], split: int) -> np.ndarray:
    """How many items each of the first ``split`` sets shares with each of the others, or all with all for 0."""
    items = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, df = np.unique(items, return_inverse=True, return_counts=True)
    rows, column = rows[df[column] > 1], column[df[column] > 1]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], np.cumsum(np.diff(column[order], prepend=column[order[:1]]) > 0)
    shared = np.zeros((split or len(sets), len(sets) - split))
    for at in range(0, column[-1] + 1 if len(column) else 0, BLOCK_COLUMNS):
        part = slice(*np.searchsorted(column, [at, at + BLOCK_COLUMNS]))
        has = np.zeros((len(sets), BLOCK_COLUMNS), np.float32)
        has[rows[part], column[part] - at] = 1
        shared += has[:split or len(sets)] @ has[split:].T
    return shared


def block_pairs(threshold: float):
    """For ``mapInArrow`` over ``low, high, block, id, set``, sorted by the blocks: ``a, b, score`` of similar sets."""
    def similar(low: int, high: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        first = t["block"].to_numpy() == low
        order = np.argsort(~first, kind="stable")
        flat, ends = t["set"].chunk(0).flatten().to_numpy(), np.cumsum(np.concatenate(
            [[0], t["set"].chunk(0).value_lengths().to_numpy()]))
        sets = [flat[ends[i]:ends[i + 1]] for i in order]
        split = 0 if low == high else int(first.sum())
        n = np.array([len(s) for s in sets], float)
        both = overlaps(sets, split)
        score = both / np.maximum(n[:split or len(n), None] + n[None, split:] - both, 1)
        at, to = np.nonzero((np.triu(score, 1) if low == high else score) >= threshold)
        ids = t["id"].chunk(0)
        out = pa.RecordBatch.from_arrays([ids.take(pa.array(order[at])), ids.take(pa.array(order[to + split])),
                                          pa.array(score[at, to])], names=["a", "b", "score"])
        return out.filter(pa.compute.not_equal(out["a"], out["b"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in chain(batches, [None]):
            ends = [0]
            if batch is not None and batch.num_rows:
                low, high = batch["low"].to_numpy(), batch["high"].to_numpy()
                ends += [*(np.flatnonzero((np.diff(low) != 0) | (np.diff(high) != 0)) + 1).tolist(), batch.num_rows]
            elif batch is not None:
                continue
            for at, to in zip(ends, ends[1:]):
                pair = int(low[at]), int(high[at])
                if held and pair != now:
                    yield similar(*now, held)
                    held = []
                now = pair
                held.append(batch.slice(at, to - at))
        if held:
            yield similar(*now, held)

    return run


def related_classes(docs: DataFrame, threshold: float = 0.6, key: str = "file_id", body: str = "text",
                    growth: int = 64) -> tuple[DataFrame, DataFrame]:
    """D11 in proportion to the files: classes ``key, class_id, members``, and the links that hold them together.

    A class has all files that RELATED_TO edges connect, directly or over others; its id is its least file. No group
    is paired out: among the sets that share a rare item one is the pivot, the others are compared with it, and those
    that stay apart form the next round with ``growth`` times as many pivots, until every two sets that share a rare
    item are compared, connected, or excluded by the exact bounds. Links are ``src, dst, score`` between first
    files, as many as were confirmed on the way, each at or above the threshold.
    """
    copied, hashed = folded(docs, key, body)
    live = cut(rare_items(hashed, threshold).drop("lead"), "rare")
    heavy = heavy_keys(live, "item")
    labels = cut(live.select("id").distinct().select("id", F.col("id").alias("label")), "labels")
    found, pivots = [], 1
    while True:
        now = live.join(labels, "id")
        apart = (now.groupBy("item").agg(F.min("label").alias("_low"), F.max("label").alias("_high"))
                 .filter("_low < _high").select("item"))
        now = cut(split_join(now, apart, "item", heavy=heavy), "live")
        if now.isEmpty():
            break
        slot = F.pmod(F.xxhash64("id", F.lit(pivots)), F.lit(pivots))
        chosen = cut(now.groupBy("item", slot.alias("_slot")).agg(F.max(F.struct("left", "id", "n", "label")).alias("p"))
                     .select("item", F.col("p.id").alias("id2"), F.col("p.n").alias("n2"), F.col("p.left").alias("left2"),
                             F.col("p.label").alias("label2")), "pivots")
        pairs = (split_join(now, chosen, "item", heavy=heavy).filter("label <> label2")
                 .filter(reachable(F.col("n"), F.col("n2"), F.col("left"), F.col("left2"), threshold))
                 .select(F.least("id", "id2").alias("src"), F.greatest("id", "id2").alias("dst")).distinct())
        links = cut(verified(cut(pairs, "pairs"), hashed, threshold), "links")
        found.append(links)
        labels = components(labels, links)
        live = now.join(chosen.select("item", F.col("id2").alias("id")), ["item", "id"], "left_anti").select(
            "item", "id", "n", "left")
        pivots *= growth
    placed = (split_join(copied, labels.toDF("_first", "label"), "_first", "left")
              .select(key, F.coalesce("label", "_first").alias("class_id")))
    sizes = placed.groupBy("class_id").agg(F.count(F.lit(1)).alias("members"))
    classes = split_join(placed, sizes, "class_id").select(key, "class_id", "members")
    none = hashed.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("score")).limit(0)
    for links in found:
        none = none.unionByName(links)
    return classes, none


# ---------------------------------------------------------------- 64-bit hashes

def average_hash(docs: DataFrame, key: str = "file_id", body: str = "text") -> DataFrame:
    """64-bit hash per text: words fall into 64 md5 cells, a bit is set for a cell above the mean."""
    cell = F.pmod(text.hash_number(F.col("_t")), F.lit(text.DIMS)).cast("int")
    counts = (docs.select(key, F.explode_outer(text.words(body)).alias("_t"))
              .groupBy(key, cell.alias("_cell")).agg(F.count("_t").alias("_n")))
    total = F.sum("_n").over(Window.partitionBy(key))
    bit = F.when(F.col("_n") * text.DIMS > F.col("_all"), F.expr("shiftleft(1L, _cell)"))
    return (counts.withColumn("_all", total).groupBy(key)
            .agg(F.coalesce(F.bit_or(bit), F.lit(0).cast("long")).alias("phash")))



def _cells(width: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, length) of ``parts`` nearly equal runs of ``width`` bits."""
    step, extra, at, out = width // parts, width % parts, 0, []
    for i in range(parts):
        size = step + (1 if i < extra else 0)
        out.append((at, size))
        at += size
    return out


def _bits(h: Column, at: int, size: int) -> Column:
    return F.shiftrightunsigned(h, at).bitwiseAND((1 << size) - 1)


def phash_pairs(df: DataFrame, d: int, key: str = "file_id", h: str = "phash") -> DataFrame:
    """Pairs of different hashes at Hamming distance <= ``d``, plus copies of one hash.

    Of ``d + 1`` bit runs at least one is equal in such a pair; of ``d + 1`` runs of the remaining
    bits one more is. Joining on both makes a popular run harmless and loses nothing. Equal hashes
    are folded first: each hash is represented by its first file, and its other files hang on that
    file at distance 0. A hash has boundedly many others within ``d`` bits.
    """
    if not 0 <= d <= 15:
        raise ValueError("d must lie in 0..15")
    firsts = df.filter(F.col(h).isNotNull()).groupBy(h).agg(F.min(key).alias("first"),
                                                           F.count(F.lit(1)).alias("_n"))
    copies = (df.select(key, h).join(firsts.filter("_n > 1"), h).filter(F.col(key) > F.col("first"))
              .select(F.col("first").alias("a"), F.col(key).alias("b"), F.lit(0).alias("distance")))
    if d == 0:
        return copies
    cells = []
    hash_col = F.col(h)
    for i, (at, size) in enumerate(_cells(64, d + 1)):
        rest = F.shiftrightunsigned(hash_col, at + size) if at + size < 64 else F.lit(0).cast("long")
        low = hash_col.bitwiseAND((1 << at) - 1) if at else F.lit(0).cast("long")
        remaining = F.shiftleft(rest, at).bitwiseOR(low) if at + size < 64 else low
        for j, (at2, size2) in enumerate(_cells(64 - size, d + 1)):
            cells.append(F.struct(F.lit(i * 100 + j).alias("cell"),
                                  _bits(hash_col, at, size).cast("long").alias("x"),
                                  _bits(remaining, at2, size2).cast("long").alias("y")))
    probes = firsts.select("first", h, F.inline(F.array(*cells)))
    left = probes.select("cell", "x", "y", F.col("first").alias("a"), F.col(h).alias("_ha"))
    right = probes.select("cell", "x", "y", F.col("first").alias("b"), F.col(h).alias("_hb"))
    distance = F.bit_count(F.col("_ha").bitwiseXOR(F.col("_hb")))
    pairs = (left.join(right, ["cell", "x", "y"]).filter("a < b")
             .select("a", "b", distance.alias("distance")).filter(F.col("distance") <= d).distinct())
    return copies.unionByName(pairs)
