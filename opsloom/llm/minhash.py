"""Near-duplicate documents: MinHash with tensored banding, verified on full shingle sets.

Each text gets two small collections of half keys, ``a`` and ``b``, each half key made of ``rows`` minhashes.
A table key is a pair ``(a_i, b_j)``: ``tables ** 2`` tables cost only ``2 * tables * rows`` minhashes. Two texts
of similarity ``s`` miss each other in all tables with probability below ``2 * (1 - s ** rows) ** tables``
(3e-4 at 0.75 with the defaults, 2e-5 at 0.8).

The pairs of half keys are made only where they can matter: a text enters the tables of ``a_i`` only if another
text has the same ``a_i``. Texts of one shingle set are one node. In each table the node of least number is the
pivot which the others are compared with. Where that leaves the nodes of a table unconnected, its nodes are
compared further, without making all pairs of a table: similar sets must share one of their rarest shingles (the
exact prefix bound), early enough in both (the exact position bound). Nodes meet by such a shingle, again around
pivots, the most central nodes first, 1, 64, 4096, ... a round, until no two nodes are left that are neither
compared, connected nor excluded by a bound. So every candidate link between components is decided on full sets,
while a group of near copies costs about as many comparisons as it has members.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; a text shorter than
a shingle is one shingle; rows without ``doc_id`` get no component and are kept; rows that repeat a
``doc_id`` count as one document; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.tokens import U64, as_long, chunks, mix, random_words, shingles
from opsloom.session import cut

SHINGLE = 5
TABLES = 16      # half keys in each of the two collections
ROWS = 3         # minhashes in a half key
SHARE, OF = 75, 100
GROWTH = 64      # how many times more pivots each further round has; the first two settle nearly all


def fingerprints(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct shingles of each text and a hash of its set."""
    n = len(bounds) - 1
    sizes, names = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=U64)
    with np.errstate(over="ignore"):
        for i in np.flatnonzero(np.diff(bounds)):
            own = np.sort(sets[bounds[i]:bounds[i + 1]])
            new = np.empty(len(own), dtype=bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            sizes[i] = np.count_nonzero(new)
            names[i] = mix(own[new]).sum(dtype=U64)
    return sizes, mix(names)


def half_keys(sets: np.ndarray, bounds: np.ndarray, count: int, rows: int, seed: int) -> np.ndarray:
    """``count`` half keys for each text with shingles, one column per key."""
    filled = np.flatnonzero(np.diff(bounds))
    keys = np.zeros((len(bounds) - 1, count), dtype=U64)
    if not len(filled):
        return keys
    at = bounds[:-1][filled]
    values = (sets >> U64(32)).astype(np.uint32)
    factors = (random_words(count * rows, seed) >> U64(32)).astype(np.uint32) | np.uint32(1)
    shifts = (random_words(count * rows, seed + 1) >> U64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for i in range(count):
            key = np.full(len(filled), U64(i + seed * 1000))
            for j in range(i * rows, (i + 1) * rows):
                least = np.minimum.reduceat((values * factors[j]) ^ shifts[j], at)
                key = mix(key * U64(0x9E3779B97F4A7C15) + least.astype(U64))
            keys[filled, i] = key
    return keys


def sketches(docs: DataFrame, shingle: int, tables: int, rows: int) -> DataFrame:
    """``doc_id, n_shingles, node, a, b`` for every row; ``node`` names the shingle set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for chunk in chunks(batch.column(1)):
                sets, bounds = shingles(chunk, chunk.hashes(), shingle)
                sizes, names = fingerprints(sets, bounds)
                halves = [half_keys(sets, bounds, tables, rows, seed) for seed in (3, 5)]
                lists = [pa.ListArray.from_arrays(np.arange(chunk.n + 1, dtype=np.int32) * tables,
                                                  as_long(h.ravel())) for h in halves]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(chunk.first, chunk.n), pa.array(sizes), as_long(names), *lists],
                    names=["doc_id", "n_shingles", "node", "a", "b"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_shingles long, node long, a array<long>, b array<long>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``node, members``: the distinct shingles of each text, named like its sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                sets, bounds = shingles(chunk, chunk.hashes(), shingle)
                _, names = fingerprints(sets, bounds)
                own = [np.unique(sets[bounds[i]:bounds[i + 1]]) for i in range(chunk.n)]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
                flat = np.concatenate(own) if own else np.zeros(0, dtype=U64)
                yield pa.RecordBatch.from_arrays(
                    [as_long(names), pa.ListArray.from_arrays(ends, as_long(flat))],
                    names=["node", "members"])

    return docs.select("text").mapInArrow(run, "node long, members array<long>")


def shared_keys(rows: DataFrame) -> DataFrame:
    """Keys that more than one node has, with the least and the number of them.

    ``rows`` are ``key, node``; partial aggregation bounds what a hot key sends.
    """
    return (rows.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("top"),
                                    F.count(F.lit(1)).alias("members"))
            .where("pivot < top").drop("top"))


def table_rows(nodes: DataFrame) -> DataFrame:
    """``key, node`` for the tables in which a node can meet another."""
    halves = nodes.select("node", F.explode("a").alias("key"))
    meet = halves.join(shared_keys(halves).select("key"), "key")
    return (meet.join(nodes.select("node", "b"), "node")
            .select("node", "key", F.explode("b").alias("other"))
            .select(F.xxhash64("key", "other").alias("key"), "node"))


def verified(pairs: DataFrame, sets: DataFrame, share: int, of: int) -> DataFrame:
    """The pairs ``u, v`` whose full sets have the asked similarity."""
    left = sets.select(F.col("node").alias("u"), F.col("members").alias("mu"))
    right = sets.select(F.col("node").alias("v"), F.col("members").alias("mv"))
    common = F.size(F.array_intersect("mu", "mv"))
    union = F.size("mu") + F.size("mv") - common
    return (pairs.join(left, "u").join(right, "v")
            .where(of * common >= share * union).select("u", "v"))


def contract(labels: DataFrame, links: DataFrame) -> DataFrame:
    """One step towards components: hang each label on its least neighbour, twice.

    ``labels`` are ``node, label``. Labels only ever become smaller labels of the same component.
    """
    ends = (links.join(labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u")
            .join(labels.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v")
            .where("lu <> lv"))
    hang = (ends.select(F.greatest("lu", "lv").alias("label"), F.least("lu", "lv").alias("below"))
            .groupBy("label").agg(F.min("below").alias("below")))
    hang = cut(hang, "hang")
    if hang.isEmpty():
        return labels
    up = hang.select(F.col("label").alias("below"), F.col("below").alias("next"))
    jump = hang.join(up, "below", "left").select("label", F.coalesce("next", "below").alias("below"))
    return cut(labels.join(jump, "label", "left")
               .select("node", F.coalesce("below", "label").alias("label")), "labels")


def connect(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The least label of each component, for every node of ``labels``."""
    while True:
        after = contract(labels, links)
        if after is labels:
            return labels
        labels = after


def rare_shingles(sets: DataFrame, share: int, of: int) -> DataFrame:
    """``key, node, n, left``: the shingles by which similar nodes must meet.

    Each set is put in the order of how many sets have a shingle. Two sets with the asked similarity share one
    of the first ``n - share * n / of + 1`` shingles of both. ``left`` is how many shingles, this one included,
    stand from here on. Shingles of one set only take places but meet nothing.
    """
    each = sets.select("node", F.size("members").alias("n"), F.explode("members").alias("key"))
    common = each.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = (each.join(common, "key").groupBy("node", "n")
               .agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("list")))
    return (ordered.select("node", "n", (F.size("list")).alias("common"), F.posexplode("list"))
            .select(F.col("col.key").alias("key"), "node", "n", (F.col("common") - F.col("pos")).alias("left"))
            .where(of * F.col("left") >= share * F.col("n")))


def link_nodes(docs: DataFrame, nodes: DataFrame, shingle: int, share: int, of: int) -> DataFrame:
    """``node, label`` for the nodes that meet another in a table; a label is the least doc_id."""
    rows = table_rows(nodes)
    met = cut(rows.join(shared_keys(rows), "key"), "tables")     # key, node, pivot, members
    sizes = nodes.select("node", "n_shingles")
    own = met.select("node").distinct().join(nodes.select("node", "doc_id"), "node")
    labels = cut(own.select("node", F.col("doc_id").alias("label")), "labels")
    wanted = docs.join(own.select("doc_id"), "doc_id", "left_semi")
    sets = cut(shingle_sets(wanted, shingle).join(labels, "node", "left_semi")
               .dropDuplicates(["node"]), "sets")
    pairs = (met.where("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
             .join(sizes.toDF("u", "nu"), "u").join(sizes.toDF("v", "nv"), "v")
             .where(of * F.least("nu", "nv") >= share * F.greatest("nu", "nv")).select("u", "v"))
    labels = connect(labels, cut(verified(pairs, sets, share, of), "links"))
    rest = met.where("members > 2 AND node <> pivot").select("key", "node").join(labels, "node")
    split = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    open_nodes = rest.join(split.select("key"), "key").select("node").distinct()
    live = cut(rare_shingles(sets.join(open_nodes, "node", "left_semi"), share, of), "rare")
    slots = 1
    while True:
        now = live.join(labels, "node")
        keys = (now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                       F.min("n").alias("least")).where("low < high").select("key", "least"))
        # a row whose rest can't reach the overlap with the smallest set here, or allowed at all, is done
        smallest = F.greatest(of * F.col("least"), share * F.col("n"))
        now = cut(now.join(keys, "key").where(
            of * (share + of) * F.col("left") >= share * (of * F.col("n") + smallest))
            .select("key", "node", "n", "left", "label"), "live")
        if now.isEmpty():
            return labels
        pivots = cut(now.groupBy("key", F.pmod(F.xxhash64("node", F.lit(slots)), F.lit(slots)).alias("slot"))
                     .agg(F.max(F.struct("left", "node", "n", "label")).alias("p"))
                     .select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"),
                             F.col("p.left").alias("pleft"), F.col("p.label").alias("plabel")), "pivots")
        pairs = (now.join(pivots, "key").where(F.col("label") != F.col("plabel"))
                 .where((share + of) * F.least("left", "pleft") >= share * (F.col("n") + F.col("pn")))
                 .select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v")).distinct())
        fresh = cut(verified(pairs, sets, share, of), "links")
        labels = labels if fresh.isEmpty() else connect(labels, fresh)
        live = (now.join(pivots.select("key", F.col("pivot").alias("node")), ["key", "node"], "left_anti")
                .select("key", "node", "n", "left"))
        slots *= GROWTH


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, share: int = SHARE, of: int = OF,
                    tables: int = TABLES, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id, text``).

    Texts are linked when their sets of ``shingle``-word shingles have a Jaccard similarity of at least
    ``share / of``; ``component_id`` is the least doc_id of the connected texts and is the one kept.
    """
    docs = docs.select("doc_id", "text")
    sketch = cut(sketches(docs, shingle, tables, rows), "sketches")
    nodes = cut(sketch.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("node")
                .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"),
                     F.first("a").alias("a"), F.first("b").alias("b")), "nodes")
    labels = link_nodes(docs, nodes, shingle, share, of)
    groups = (nodes.select("node", "doc_id").join(labels, "node", "left")
              .select("node", F.coalesce("label", "doc_id").alias("component_id")))
    out = sketch.select("doc_id", "n_shingles", "node").join(groups, "node", "left")
    group = F.when(F.col("doc_id").isNotNull(),
                   F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return (out.select("doc_id", "n_shingles", group.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
