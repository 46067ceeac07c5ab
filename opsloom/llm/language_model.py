"""Language-model scores: deleted interpolation of bigram, unigram and uniform estimates.

``P(w | v) = l2(b) c(v, w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1)`` where ``b`` is the frequency bucket of the
context ``v`` (two buckets an octave of ``c(v)``; a text's first word has the end of a text as its context). The weights ``l``
come from expectation-maximisation on a part of the training texts whose counts are deleted from the model
meanwhile; the final model counts all training texts.

How it runs. Texts are read once and become *blocks*: some megabytes of text as word hashes, written to
the shared folder. Each block asks for the corpus counts of its distinct words and word pairs, packed by ranges
of their hashes; a range sums what all blocks say about it and answers each block with plain counts in the order
asked, so the answer carries no keys. Every block is then scored by itself. A frequent word costs one entry per
block, so no word is hot; no vocabulary, count or text is collected or broadcast. The number of ranges
follows the number of tokens. EM needs only how often each (bucket, bigram ratio, unigram ratio) occurs on a
fixed logarithmic grid; that grid bounds what reaches the driver.

Defined results: a null or empty text is one end token; rows without an id count as training texts; repeated
rows are scored each; without training texts every count is 0 and the model is uniform over one unknown token.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.packing import pack, pack_keys, pack_planes, unpack, unpack_counts, unpack_keys, unpack_planes
from opsloom.llm.samples import text_remainder
from opsloom.llm.tokens import U64, chunks, mix
from opsloom.session import cut

BLOCK_BYTES = 6 << 20          # text of one block; a longer text is a block of its own
RANGE_TOKENS = 2 << 20         # tokens behind one range of hashes
END = U64(0x243F6A8885A308D3)  # the end token; also the context of a text's first word
MODEL, DELETED, HELD_OUT = 0, 1, 2
GRID = 8                       # cells an octave of the EM grid
CELLS = 512                    # cells of one ratio; smaller ratios share the last one
BUCKETS = 64


def key_bits(tokens: int) -> int:
    """Bits of a pair's key: so many that less than one collision is to be expected among all pairs."""
    return min(64, 2 * max(tokens, 1).bit_length() + 2)


def pair_keys(hashes: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """A key for each token together with the token before it; ``ends`` are token offsets of texts."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[ends[:-1][ends[:-1] < len(hashes)]] = END
    with np.errstate(over="ignore"):
        return mix(before * U64(0x9FB21C651E98DF25) + hashes) >> U64(64 - bits)


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Neighbouring texts of one role as word hashes.

    Each row: its number, role, document ids, token counts of texts, the block's distinct words and the place
    of each token among them. A number is made of partition and sequence; blocks are written once and then
    read, so a number stays the name of one block.
    """
    def one(block: int, role: int, ids: list, sizes: list[np.ndarray], hashes: list[np.ndarray]) -> dict:
        size, flat = np.concatenate(sizes), np.concatenate(hashes)
        words, places = np.unique(flat, return_inverse=True)
        return {"block": block, "role": role, "ids": ids, "n_tokens": len(flat), "sizes": pack(size),
                "words": pack_keys(words), "places": pack_planes(places, 4)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {r: [[], [], [], 0] for r in (MODEL, DELETED, HELD_OUT)}
        number = count(TaskContext.get().partitionId() << 32)
        schema = pa.schema([("block", pa.int64()), ("role", pa.int32()), ("ids", pa.list_(pa.int64())),
                            ("n_tokens", pa.int64()), ("sizes", pa.binary()), ("words", pa.binary()),
                            ("places", pa.binary())])

        def leave(role: int) -> pa.RecordBatch:
            ids, sizes, hashes, _ = held[role]
            held[role] = [[], [], [], 0]
            return pa.RecordBatch.from_pylist([one(next(number), role, ids, sizes, hashes)], schema)

        for batch in batches:
            ids, roles = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            for chunk in chunks(batch.column(1)):
                counts = chunk.counts
                ends = np.cumsum(counts + 1)
                flat = np.full(len(chunk.starts) + chunk.n, END)
                inner = np.ones(len(flat), dtype=bool)
                inner[ends - 1] = False
                flat[inner] = chunk.hashes()
                mine = roles[chunk.first:chunk.first + chunk.n]
                for role in np.unique(mine):
                    at = np.flatnonzero(mine == role)
                    own = held[int(role)]
                    own[0] += [ids[chunk.first + i] for i in at]
                    own[1].append(counts[at] + 1)
                    own[2].append(flat[np.repeat(mine == role, counts + 1)])
                    own[3] += int((chunk.offsets[at + 1] - chunk.offsets[at]).sum()) + len(at)
                    if own[3] >= block_bytes:
                        yield leave(int(role))
        for role in held:
            if held[role][0]:
                yield leave(role)

    role = (F.when(text_remainder("doc_id", 5) == 1, HELD_OUT)
            .when(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10)) == 0, DELETED).otherwise(MODEL))
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                        role.cast("int").alias("role"))
            .mapInArrow(run, "block long, role int, ids array<long>, n_tokens long, sizes binary, "
                             "words binary, places binary"))


def tokens_of(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, place of each token among them and token offsets of texts."""
    words, places = unpack_keys(row.words), unpack_planes(row.places, 4)
    return words, places, np.concatenate(([0], np.cumsum(unpack(row.sizes, np.int64))))


def range_of(keys: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Number of the hash range of each key; sorted keys have sorted ranges."""
    return ((keys << U64(64 - bits) >> U64(32)) * U64(ranges)) >> U64(32)


def asked(stored: DataFrame, ranges: int, bits: int) -> DataFrame:
    """What blocks ask of ranges: their keys and how often the block itself has them."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                words, places, ends = tokens_of(row)
                pairs, times = np.unique(pair_keys(words[places], ends, bits), return_counts=True)
                out = []
                for kind, keys, own, width in ((1, words, np.bincount(places, minlength=len(words)), 64),
                                               (2, pairs, times, bits)):
                    edges = np.searchsorted(range_of(keys, ranges, width), np.arange(ranges + 1, dtype=U64))
                    out += [(r, kind, row.block, row.role, pack_keys(keys[a:b]), pack_planes(own[a:b]))
                            for r, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
                yield pd.DataFrame(out, columns=["part", "kind", "block", "role", "keys", "own"])

    return stored.select("block", "role", "sizes", "words", "places").mapInPandas(
        run, "part int, kind int, block long, role int, keys binary, own binary")


def answered(requests: DataFrame) -> DataFrame:
    """Counts of all training texts and of the deleted ones among them, for every request.

    One row per block, kind and range; deleted counts go to blocks of deleted texts only. A row with a null block instead has a range's distinct words and
    tokens of training texts.
    """
    def run(key: tuple[int, int], frame: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_keys(k) for k in frame["keys"]]
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        own = [unpack_counts(c) for c in frame["own"]]
        ends = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
        roles = np.repeat(frame["role"].to_numpy(), np.diff(ends))
        flat = np.concatenate(own)

        def total(chosen: np.ndarray) -> np.ndarray:
            return np.bincount(where[chosen], flat[chosen], len(every)).astype(np.int64)

        deleted = total(roles == DELETED)
        training = deleted + total(roles == MODEL)
        out = [(key[0], key[1], block, pack_planes(training[where[a:b]]),
                pack_planes(deleted[where[a:b]]) if role == DELETED else b"", 0, 0)
               for block, role, a, b in zip(frame["block"], frame["role"], ends[:-1], ends[1:])]
        if key[1] == 1:
            out.append((key[0], 0, None, b"", b"", int(np.count_nonzero(training)), int(training.sum())))
        made = pd.DataFrame(out, columns=["part", "kind", "block", "training", "deleted", "distinct", "tokens"])
        return made.astype({"block": "Int64"})

    return requests.groupBy("part", "kind").applyInPandas(
        run, "part int, kind int, block long, training binary, deleted binary, distinct long, tokens long")


def answers_by_block(stored: DataFrame, answers: DataFrame, columns: list[str]) -> DataFrame:
    """Each block with its answers as two lists in the order of ranges."""
    def ordered(kind: int, column: str):
        mine = F.when(F.col("kind") == kind, F.struct("part", column))
        return F.transform(F.array_sort(F.collect_list(mine)), lambda x: x[column]).alias(f"{column}{kind}")

    wanted = [ordered(kind, column) for kind in (1, 2) for column in columns]
    gathered = (answers.where("block IS NOT NULL").groupBy("block").agg(*wanted))
    return stored.join(gathered, "block")


def joined(parts) -> np.ndarray:
    return np.concatenate([unpack_counts(p) for p in parts])


def estimates(row, bits: int, deleted: bool):
    """For each token of a block: counts of the pair, its context and the word; token offsets of texts."""
    words, places, ends = tokens_of(row)
    _, which = np.unique(pair_keys(words[places], ends, bits), return_inverse=True)
    single, pair = joined(row.training1), joined(row.training2)
    if deleted:
        single, pair = single - joined(row.deleted1), pair - joined(row.deleted2)
    word, both = single[places], pair[which]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    # every text ends once, so the count of ends is the count of the context of first words
    ending = word[ends[1:] - 1][0] if len(ends) > 1 else 0
    context[ends[:-1][ends[:-1] < len(word)]] = ending
    return both, context, word, ends


def bucket(context: np.ndarray) -> np.ndarray:
    """Frequency bucket of a context: 0 for none, then two an octave."""
    return np.where(context > 0, np.minimum(1 + (2 * np.log2(np.maximum(context, 1))).astype(int), BUCKETS - 1), 0)


def cell(ratio: np.ndarray) -> np.ndarray:
    """Place of a probability on the logarithmic grid; the last place is for none."""
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, np.minimum(np.round(-GRID * np.log2(ratio)), CELLS - 2), CELLS - 1).astype(int)


def mixture_weights(cells: pd.DataFrame, vocabulary: int, rounds: int = 60) -> np.ndarray:
    """``BUCKETS x 3`` weights of bigram, unigram and uniform estimate by EM on grid counts.

    Each bucket starts from the weights of all buckets together, so a bucket with few tokens stays near them.
    """
    weights = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    weights[1:] = [0.45, 0.45, 0.1]
    if not len(cells):
        return weights
    b, n = cells["bucket"].to_numpy(), cells["n"].to_numpy().astype(float)
    grid = np.append(2.0 ** (-np.arange(CELLS - 1) / GRID), 0.0)
    p = np.column_stack([grid[cells["pair"].to_numpy()], grid[cells["word"].to_numpy()],
                         np.full(len(cells), 1 / (vocabulary + 1))])
    start = np.array([0.45, 0.45, 0.1])
    for _ in range(rounds):
        share = p * start
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        start = share.sum(axis=0) / n.sum()
    weights[:] = np.maximum(start, 1e-6)
    weights[0, 0] = 0.0
    weights /= weights.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        share = p * weights[b]
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        for k in range(3):
            weights[:, k] = np.bincount(b, share[:, k], BUCKETS) + 10 * weights[:, k]
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


def held_out_cells(met: DataFrame, bits: int, tokens: int) -> DataFrame:
    """How often each cell of the EM grid occurs in the deleted texts."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                both, context, word, _ = estimates(row, bits, deleted=True)
                code = ((bucket(context) * CELLS + cell(both / np.maximum(context, 1))) * CELLS
                        + cell(word / max(tokens, 1)))
                codes, times = np.unique(code, return_counts=True)
                yield pd.DataFrame({"code": codes, "n": times})

    return met.mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def score_blocks(met: DataFrame, weights: np.ndarray, bits: int, tokens: int, vocabulary: int) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every text of the blocks."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                both, context, word, ends = estimates(row, bits, deleted=False)
                w = weights[bucket(context)]
                p = (w[:, 0] * both / np.maximum(context, 1) + w[:, 1] * word / max(tokens, 1)
                     + w[:, 2] / (vocabulary + 1))
                base = np.log10((word + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
                at = ends[:-1]
                yield pd.DataFrame({
                    "doc_id": pd.array(list(row.ids), dtype="Int64"), "n_tokens": np.diff(ends),
                    "n_known": np.add.reduceat((word > 0).astype(np.int64), at),
                    "base_score": np.add.reduceat(base, at),
                    "score": np.add.reduceat(np.log10(p), at)})

    return met.mapInPandas(
        run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score_texts(docs: DataFrame, block_bytes: int = BLOCK_BYTES,
                range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """Scores of every text under the model learnt from the texts that are not held out."""
    stored = cut(blocks(docs, block_bytes), "blocks")
    size = stored.agg(F.sum("n_tokens")).first()[0] or 0
    ranges = int(max(1, -(-size // range_tokens)))
    bits = key_bits(size)
    answers = cut(answered(asked(stored, ranges, bits)), "answers")
    vocabulary, tokens = answers.where("block IS NULL").agg(
        F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    both = ["training", "deleted"]
    left_out = answers_by_block(stored.where(F.col("role") == DELETED), answers, both)
    deleted_tokens = stored.where(F.col("role") == DELETED).agg(F.sum("n_tokens")).first()[0] or 0
    cells = held_out_cells(left_out, bits, tokens - deleted_tokens).toPandas()
    code = cells["code"].to_numpy().astype(np.int64)
    cells = pd.DataFrame({"bucket": code // CELLS**2, "pair": code // CELLS % CELLS, "word": code % CELLS,
                          "n": cells["n"].to_numpy()})
    cells = cells.sort_values(["bucket", "pair", "word"])
    weights = mixture_weights(cells, vocabulary)
    met = answers_by_block(stored, answers, ["training"])
    scored = score_blocks(met, weights, bits, tokens, vocabulary)
    return scored.select("doc_id", (text_remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known",
                         F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
