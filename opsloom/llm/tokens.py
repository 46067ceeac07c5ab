"""Words and their hashes for whole batches of texts, without a Python step per word.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return;
letters are lower-cased for A-Z only. A word's hash is a polynomial over its bytes, taken from one running
sum over the bytes of many texts, so numpy does all the work. Hashes depend on content alone: every executor,
every run and every retry finds the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 19          # texts handled together; a longer text is a chunk of its own
_BASE = 0x9E3779B97F4A7C15     # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values for a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(_BASE) + U64(seed) * U64(0xD1342543DE82EF95))


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CODES = random_words(256, 1)
LOWER_CODES = CODES[LOWER]
NOT_ALNUM = np.ones(256, dtype=bool)   # everything but ASCII letters and digits and non-ASCII characters
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
CONTINUES = (np.arange(256) & 0xC0) == 0x80    # second and later bytes of a UTF-8 character

_powers = {"up": np.ones(1, dtype=U64), "down": np.ones(1, dtype=U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, grown as texts need them."""
    if len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            step = np.full(size, U64(base))
            step[0] = U64(1)
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(step)
    return _powers["up"][:n], _powers["down"][:n]


@dataclass
class Chunk:
    """Some neighbouring texts: rows ``first`` to ``first + n - 1`` of a batch."""

    first: int
    n: int
    data: np.ndarray       # bytes of the texts, one after the other
    offsets: np.ndarray    # n + 1 byte offsets
    starts: np.ndarray     # byte offset of each word
    ends: np.ndarray
    bounds: np.ndarray     # n + 1 word offsets: text i has words bounds[i] to bounds[i + 1] - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of every word."""
        codes = (LOWER_CODES if lower else CODES)[self.data]
        return self.ranges(codes, self.starts, self.ends)

    @staticmethod
    def ranges(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges whose bytes have the given codes."""
        up, down = powers(len(codes) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(codes) + 1, dtype=U64)
            np.cumsum(codes * up[:-1], out=total[1:])
            return mix((total[ends] - total[starts]) * down[starts])

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a missing text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return offsets, data


def chunk_of(first: int, offsets: np.ndarray, data: np.ndarray, gaps: np.ndarray = SPACE) -> Chunk:
    base = offsets[0]
    data, offsets = data[base:offsets[-1]], offsets - base
    solid = ~gaps[data]
    before, after = np.ones(len(data), dtype=bool), np.ones(len(data), dtype=bool)
    if len(data):
        np.logical_not(solid[:-1], out=before[1:])
        np.logical_not(solid[1:], out=after[:-1])
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        before[inner] = True
        after[inner - 1] = True
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    return Chunk(first, len(offsets) - 1, data, offsets, starts, ends, np.searchsorted(starts, offsets))


def chunks(column: pa.Array | pa.ChunkedArray, gaps: np.ndarray = SPACE,
           size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a column in chunks of bounded size, in order; ``gaps`` marks bytes between words."""
    offsets, data = text_buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield chunk_of(first, offsets[first:last + 1], data, gaps)
        first = last


def runs_of(hashes: np.ndarray, k: int, seed: int = 2) -> np.ndarray:
    """Hash of every run of ``k`` neighbouring words, whatever text they are in."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    weights = random_words(k, seed) | U64(1)
    with np.errstate(over="ignore"):
        total = hashes[:n] * weights[0]
        for j in range(1, k):
            total += hashes[j:j + n] * weights[j]
    return mix(total)


def shingles(chunk: Chunk, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's ``k``-word shingles and their ``n + 1`` offsets.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    counts = chunk.counts
    runs = runs_of(hashes, k)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    # a text's first shingle stands where its first word stands
    where = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes) + np.repeat(chunk.bounds[:-1], sizes)
    short = np.flatnonzero((counts > 0) & (counts < k))
    out = np.zeros(bounds[-1], dtype=U64)
    whole = np.repeat(counts >= k, sizes)
    out[whole] = runs[where[whole]]
    for i in short:
        own = hashes[chunk.bounds[i]:chunk.bounds[i + 1]]
        out[bounds[i]] = runs_of(own, len(own), 16 + len(own))[0]
    return out, bounds


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
