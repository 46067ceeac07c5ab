"""Token counts by a finite-state form of a byte-pair tokenizer.

The vocabulary is compiled to one deterministic transducer over bytes. Its state joins the splitting of a text into
words (letters, single numbers, other signs, contractions) with the merges inside the word at hand: the longest end
of the word that may still grow into a token, and for each place in it where a token may begin, the token before that
place. By the rule that a sequence of tokens is the merged one exactly if every two neighbours are, this is all
that decides what follows. A transition carries the number of tokens that are certain once it is taken; only the last
byte of a word is held back, because a token at a word's end is another one than inside.
States and transitions are made when a text first needs them and kept for the texts after it.

Texts are cut to chunks, after white space where there is some. Chunks run side by side through the transitions; a
chunk that begins inside a word runs from a guess taken a little before its start and from every state in
which the chunk before it can end. Each chunk so becomes a map from start state to end state and count, and a
parallel prefix scan composes the maps of a text. No text is cut short and nothing is shuffled: a text's chunks stay
in the task that read it.

Results for odd input: a null or empty text has 0 bytes and 0 tokens; blank texts have bytes and no tokens. Repeated
rows and ids give one row each, a null id stays null. Empty tables give an empty result. Strings of special tokens in
a text count as one token, as the library does by default. Only ``doc_id`` and the text column are read, so other
columns may have any name. Very long texts take memory in proportion to their length, a few dozen bytes a byte.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

LIMIT = 2048                  # tokens above which a text is marked
CHUNK = 256                   # bytes of a chunk; chunks have less than twice as many
LOOK_BACK = 48                # bytes before a chunk from which its start state is guessed
BATCH_CHARS = 1_000_000       # characters that run side by side
STATES = 250_000              # states kept; beyond them the machine starts anew, results are the same
CANDIDATES = 8                # start states followed for each chunk before the true one is waited for

LETTER, NUMBER, OTHER, INSIDE, SPACE, SPECIAL = range(1, 7)    # kinds of bytes: first of a character, later ones
SPACE_SYMBOL, SPECIAL_SYMBOL = SPACE << 8, SPECIAL << 8
MARK = "\ud800"               # stands for a special token; no text can hold it
APOSTROPHE = ord("'")
CONTRACTIONS = {"s": "", "t": "", "m": "", "d": "", "r": "e", "v": "e", "l": "l"}    # fixed: 's 't 'm 'd 're 've 'll


def byte_letters() -> dict[str, int]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Merges:
    """Which sequences of tokens the merges give. A token is (its bytes, whether it ends a word)."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        of = byte_letters()

        def token(name: str) -> tuple[bytes, bool]:
            end = name.endswith(suffix)
            return bytes(of[c] for c in (name[:-len(suffix)] if end else name)), end

        self.ranks = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((token(a), token(b)), rank)
        self.inner, self.final, self.prefixes = {}, {}, {}     # each name once, so that states share them
        for name in vocab:
            word, end = token(name)
            (self.final if end else self.inner)[word] = (word, end)
            for k in range(1, len(word)):
                self.prefixes.setdefault(word[:k], word[:k])
        if any(bytes([b]) not in kind for kind in (self.inner, self.final) for b in range(256)):
            raise ValueError("the vocabulary doesn't hold every byte")
        self.known: dict[tuple, bool] = {}

    def merged(self, parts: list) -> list:
        while len(parts) > 1:
            rank, at = min((self.ranks.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            (a, _), (b, end) = parts[at], parts[at + 1]
            parts[at:at + 2] = [(a + b, end)]
        return parts

    def neighbours(self, a: tuple[bytes, bool] | None, b: tuple[bytes, bool]) -> bool:
        """Whether token ``b`` can follow ``a`` within a word; ``None`` is the word's start."""
        key = (a, b)
        if key not in self.known:
            word, end = b
            own = [(word[i:i + 1], end and i == len(word) - 1) for i in range(len(word))]
            before = [] if a is None else [(a[0][i:i + 1], False) for i in range(len(a[0]))]
            self.known[key] = self.merged(before + own) == ([b] if a is None else [a, b])
        return self.known[key]


# The merges inside a word so far: its longest end that begins a token, and for each place in that end where a
# token may begin (bytes from the end) the token before it and the tokens counted up to there.
Core = tuple[bytes, tuple[tuple[int, tuple[bytes, bool] | None, int], ...]]
FRESH: Core = (b"", ((0, None, 0),))


class Machine:
    """The transducer: states are numbers, a table gives next state and token count for state and symbol."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        model, self.specials = spec["model"], [t["content"] for t in spec["added_tokens"]]
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens that look at what is around them can't be compiled")
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        library = Tokenizer.from_str(vocabulary.decode())
        self.normal, self.split = library.normalizer, library.pre_tokenizer
        self.special = re.compile("|".join(re.escape(s) for s in self.specials)) if self.specials else None
        self.kind = np.full(0x110000, 255, dtype=np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        self.longer: dict[str, str] = {}
        self.learn(np.arange(128))
        self.kind[ord(MARK)] = SPECIAL
        self.pushed: dict[tuple, tuple[Core, int]] = {}
        self.places: dict[tuple, tuple] = {}
        self.reset()

    # --- characters

    def learn(self, points: np.ndarray) -> None:
        """Kind and lower-case form of characters, as the library's own normaliser and splitter have them."""
        for point in points.tolist():
            if self.kind[point] != 255:
                continue
            text = self.normal.normalize_str(chr(point))
            if len(text) > 1:
                self.longer[chr(point)] = text
                self.learn(np.array([ord(c) for c in text]))
                self.kind[point] = OTHER
                continue
            pieces = len(self.split.pre_tokenize_str(f"a{text}a"))
            twice = len(self.split.pre_tokenize_str(text + text))
            kind = LETTER if pieces == 1 else SPACE if twice == 0 else NUMBER if twice == 2 else OTHER
            self.kind[point], self.lower[point] = kind, 32 if kind == SPACE else ord(text)

    def plain(self, text: str) -> str:
        """Composed characters, special tokens replaced by their mark."""
        parts = self.special.split(text) if self.special and "<" in text else [text]
        return MARK.join(p if p.isascii() or unicodedata.is_normalized("NFC", p) else unicodedata.normalize("NFC", p)
                         for p in parts)

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the texts, each one followed by white space, and where each text begins."""
        texts = [self.plain(t) for t in texts]
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        new = np.flatnonzero(np.bincount(points[self.kind[points] == 255])) if (self.kind[points] == 255).any() else []
        if len(new):
            self.learn(new)
        if self.longer and np.isin(points, [ord(c) for c in self.longer]).any():
            swap = str.maketrans(self.longer)
            texts = [t.translate(swap) for t in texts]
            points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds, starts = self.kind[points], np.cumsum([0, *[len(t) + 1 for t in texts]])
        points = np.where(kinds == SPECIAL, np.uint32(32), self.lower[points])
        data = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
        firsts = np.flatnonzero((data & 0xC0) != 0x80)
        out = data.astype(np.uint16) | np.uint16(INSIDE << 8)
        out[firsts] = np.where(kinds >= SPACE, 0, data[firsts]) | kinds.astype(np.uint16) << 8
        return out, np.append(firsts, len(data))[starts]

    # --- the merges inside a word

    def push(self, core: Core, byte: int) -> tuple[Core, int]:
        """The word goes on with a byte: the new core, and how many tokens have become certain."""
        key = (core, byte)
        if key not in self.pushed:
            end, places = core
            grown = end + bytes([byte])
            token, n = next((token, n + 1) for k, before, n in reversed(places)
                            if (token := self.merges.inner.get(grown[len(end) - k:]))
                            and self.merges.neighbours(before, token))
            kept = [(k + 1, before, m) for k, before, m in places if grown[len(end) - k:] in self.merges.prefixes]
            kept = [(0, token, n), *kept]
            sure = min(m for _, _, m in kept)
            kept = tuple(self.places.setdefault(p, p) for k, before, m in kept for p in [(k, before, m - sure)])
            grown = grown[len(grown) - kept[-1][0]:]
            self.pushed[key] = ((self.merges.prefixes.get(grown, grown), kept), sure)
        return self.pushed[key]

    def finish(self, core: Core, byte: int) -> int:
        """The word ends with a byte: the tokens not counted yet."""
        end, places = core
        last = end + bytes([byte])
        return next(n + 1 for k, before, n in reversed(places)
                    if (token := self.merges.final.get(last[len(end) - k:])) and self.merges.neighbours(before, token))

    # --- words

    def close(self, state: tuple) -> int:
        """Tokens that the end of the word at hand adds."""
        mode, core, held = state
        if mode == "'":                                     # an apostrophe, perhaps with the first of two letters
            return self.finish(FRESH, APOSTROPHE) + (self.finish(FRESH, held) if held else 0)
        return self.finish(core, held) if mode else 0

    def step(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        """Next state and count. A state is (mode, core, byte held back); modes: none between words, the kind within
        one, an apostrophe that may begin a contraction, "." after a contraction."""
        (mode, core, held), kind, byte = state, symbol >> 8, symbol & 255
        if kind >= SPACE:
            return ("", FRESH, 0), self.close(state) + (kind == SPECIAL)
        if kind == INSIDE or (kind == mode and kind != NUMBER):
            core, n = self.push(core, held) if mode != "" else (core, 0)
            return (mode, core, byte), n
        if mode == "'":
            letters = chr(held) if held else ""
            word, n = self.push(FRESH, APOSTROPHE)
            if kind == LETTER and not held and chr(byte) in CONTRACTIONS:
                return (("'", FRESH, byte), 0) if CONTRACTIONS[chr(byte)] else ((".", word, byte), n)
            if kind == LETTER and held and CONTRACTIONS[letters] == chr(byte):
                word, m = self.push(word, held)
                return (".", word, byte), n + m
            if kind == LETTER and held:                     # it was no contraction: a sign, then a word
                word, n = self.push(FRESH, held)
                return (LETTER, word, byte), self.finish(FRESH, APOSTROPHE) + n
            if kind == OTHER and not held:
                return (OTHER, word, byte), n
        opens = "'" if kind == OTHER and byte == APOSTROPHE else kind
        return (opens, FRESH, 0 if opens == "'" else byte), self.close(state)

    # --- the table

    def reset(self) -> None:
        self.states, self.numbers = [("", FRESH, 0)], {("", FRESH, 0): 0}
        self.pushed.clear()
        self.places.clear()
        self.merges.known.clear()
        self.filled, self.keys, self.values = 0, np.full(1 << 12, -1, np.int64), np.zeros(1 << 12, np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        bits = len(self.keys).bit_length() - 1
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free place where it belongs."""
        at = self.slots(keys)
        seen = self.keys[at]
        off = np.flatnonzero((seen != keys) & (seen != -1))
        while len(off):
            at[off] = (at[off] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[off]]
            off = off[(seen != keys[off]) & (seen != -1)]
        return at

    def add(self, keys: np.ndarray) -> None:
        """Make transitions (state * 2048 + symbol)."""
        keys = np.unique(keys)
        values = np.empty_like(keys)
        for i, key in enumerate(keys.tolist()):
            state, n = self.step(self.states[key >> 11], key & 2047)
            number = self.numbers.setdefault(state, len(self.states))
            if number == len(self.states):
                self.states.append(state)
            values[i] = number << 8 | n
        while (self.filled + len(keys)) * 4 > len(self.keys):
            self.grow()
        self.store(keys, values)

    def grow(self) -> None:
        old = np.flatnonzero(self.keys != -1)
        keys, values = self.keys[old], self.values[old]
        self.filled, size = 0, len(self.keys) * 4
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.store(keys, values)

    def store(self, keys: np.ndarray, values: np.ndarray) -> None:
        while len(keys):
            at = self.place(keys)
            self.keys[at] = keys                # of several keys that want one place the last one gets it
            own = self.keys[at] == keys
            self.values[at[own]] = values[own]
            self.filled += int(own.sum())
            keys, values = keys[~own], values[~own]

    def run(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray):
        """End states and counts of stretches of symbols, one step for all of them at a time."""
        order = np.argsort(-size, kind="stable")
        start, state, size = start[order], state[order].copy(), size[order]
        count, longest = np.zeros(len(order), np.int64), int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
        for t in range(longest):
            n = live[t]
            keys = state[:n] << 11 | data[start[:n] + t]
            at = self.place(keys)
            new = self.keys[at] != keys
            if new.any():
                self.add(keys[new])
                at = self.place(keys)
            found = self.values[at]
            state[:n] = found >> 8
            count[:n] += found & 255
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    # --- chunks and their maps

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.states) > STATES:
            self.reset()
        data, starts = self.symbols(texts)
        begin, known = cuts(data, starts)
        size, text = np.diff(np.append(begin, len(data))), np.searchsorted(starts, begin, side="right") - 1
        state = np.zeros(len(begin), np.int64)
        inner = np.flatnonzero(~known)
        state[inner] = self.run(data, begin[inner] - LOOK_BACK, np.full(len(inner), LOOK_BACK), state[inner])[0]
        end, count = self.run(data, begin, size, state)
        if len(inner):
            count = self.compose(data, begin, size, known, state, end, count)
        return np.bincount(text, count, len(texts)).astype(np.int64)

    def compose(self, data, begin, size, known, state, end, count) -> np.ndarray:
        """Counts of the chunks from their true start states.

        ``maps`` holds the start states tried for each chunk with their ends and counts; they are added to until
        the scan finds a true start for every chunk.
        """
        maps = [{s: (e, c)} for s, e, c in zip(state.tolist(), end.tolist(), count.tolist())]
        while True:
            true = scan(maps, known)
            wanted = []
            for j in np.flatnonzero(~known).tolist():
                ends = {e for e, _ in maps[j - 1].values()} if len(maps[j]) < CANDIDATES else set()
                if true[j - 1] in maps[j - 1]:
                    ends.add(maps[j - 1][true[j - 1]][0])
                wanted += [(j, s) for s in ends if s not in maps[j]]
            if all(s in m for s, m in zip(true, maps)):
                return np.array([m[s][1] for s, m in zip(true, maps)])
            at = np.array([j for j, _ in wanted])
            ends, counts = self.run(data, begin[at], size[at], np.array([s for _, s in wanted]))
            for (j, s), e, c in zip(wanted, ends.tolist(), counts.tolist()):
                maps[j][s] = (e, c)


def cuts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin, and whether a word can't go on there: at a text's start and after white space."""
    sizes = np.diff(starts)
    n = np.maximum(sizes - 1, 0) // CHUNK
    nominal = np.repeat(starts[:-1], n) + CHUNK * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
    spaces = np.flatnonzero(data >= SPACE_SYMBOL)
    after = spaces[np.searchsorted(spaces, nominal)] + 1
    snapped = after < np.minimum(nominal + CHUNK, np.repeat(starts[1:], n))
    raw = ~snapped & (np.repeat(starts[1:], n) - nominal > CHUNK)
    begin = np.concatenate([starts[:-1], after[snapped], nominal[raw]])
    known = np.arange(len(begin)) < len(starts) - 1 + snapped.sum()
    order = np.argsort(begin, kind="stable")
    begin, known = begin[order], known[order]
    first = np.append(True, np.diff(begin) > 0)
    return begin[first], known[first]


def scan(maps: list[dict], known: np.ndarray) -> list[int]:
    """True start state of each chunk, -1 where the maps don't tell yet, by a parallel prefix scan.

    A chunk's map goes from the places of its start states to the places of those of the next chunk. After the round
    of width w a chunk holds the composed map of itself and the w - 1 chunks before it; chunks with a known start
    have one start state only, so nothing from before them passes.
    """
    width = max(len(m) for m in maps) + 1                              # the last place: not known
    lists = [list(m) for m in maps]
    step = np.full((len(maps), width), width - 1)
    for j in range(1, len(maps)):
        if known[j]:
            step[j - 1] = 0
            continue
        places = {s: k for k, s in enumerate(lists[j])}
        for k, s in enumerate(lists[j - 1]):
            step[j - 1, k] = places.get(maps[j - 1][s][0], width - 1)
    w = 1
    while w < len(maps):
        step[w:] = np.take_along_axis(step[w:], step[:-w], axis=1)     # first the earlier chunks, then the own ones
        w *= 2
    return [lists[0][0]] + [lists[j][k] if k < len(lists[j]) else -1 for j, k in enumerate(step[:-1, 0].tolist(), 1)]


_machines: dict[bytes, Machine] = {}


def machine(vocabulary: bytes) -> Machine:
    """The machine of this worker process for a vocabulary."""
    if vocabulary not in _machines:
        _machines.clear()
        _machines[vocabulary] = Machine(vocabulary)
    return _machines[vocabulary]


def groups(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in lists of bounded length; a longer text has a list of its own."""
    own, size = [], 0
    for text in texts:
        text = text.as_py() or ""
        if own and size + len(text) > BATCH_CHARS:
            yield own
            own, size = [], 0
        own.append(text)
        size += len(text) + 1
    if own:
        yield own


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    ``vocabulary`` is the path of a tokenizer file on the driver; its few megabytes are shipped with the job, so
    executors need no such file.
    """
    with open(vocabulary, "rb") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = machine(shipped.value)
            counts = [own.count(part) for part in groups(batch.column(2))]
            tokens = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens)],
                                             ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
                       F.col(text).cast("string").alias("text"))
    out = read.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
