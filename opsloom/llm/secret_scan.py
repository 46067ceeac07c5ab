"""Secret scan: fixed patterns plus a token-efficiency test.

Patterns find assignments, access keys and long hexadecimal runs. The test looks at the other long runs of key
characters: a byte-pair vocabulary packs words and names of a language well and random strings badly, so
a run with few characters per token is random. A run that is not is tested in its parts between ``/ _ - +``, without
plain words and numbers, and long parts in windows, so words beside a random part don't hide it. UUIDs and
spans found by the patterns are left out of a run and the rest of it is tested. Known digests (hexadecimal or labelled with a digest's name),
UUIDs, plain numbers and runs of one letter case without digits are identifiers, not secrets, for this test;
spans found by the patterns stay whatever the test says.

Spans are ``kind, start, end`` in code points of the text, the end exclusive; a span of an assignment is the whole
assignment. Defined results: null and empty texts have no spans; texts of any length are read whole; repeated
rows give repeated results; rows without an id are scanned too; an empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHARS_PER_TOKEN = 2.0    # runs with fewer characters per token count as random
LEAST_RUN = 16
WINDOW = 20              # long parts are tested in windows of so many characters, too
KINDS = ["assign", "access", "hex", "random"]

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                     re.IGNORECASE | re.ASCII)
_WORDS = ("passw", "secret", "token", "api")   # every assignment has one of these
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_LONG = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_DIGEST_NAME = re.compile(r"(md5|sha-?(1|224|256|384|512)|blake\w*|crc\w*|commit|etag|integrity)[\"']?\s*[:=-]\s*[\"']?$",
                          re.IGNORECASE)
_LABEL = re.compile(_DIGEST_NAME.pattern.removesuffix("$"), re.IGNORECASE)
# Lengths of digests in hexadecimal and in base 64 without its filling.
_DIGEST = re.compile("(?:" + "|".join([f"[0-9A-Fa-f]{{{n}}}" for n in (128, 96, 64, 56, 40, 32, 16, 8)]
                                      + [f"[A-Za-z0-9+/]{{{n}}}" for n in (86, 64, 43, 38, 27, 22)])
                     + r")(?![A-Za-z0-9+/])")
_PART = re.compile(r"[A-Za-z0-9]+")
_PLAIN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HEX_ONLY = re.compile(r"[0-9A-Fa-f]+|0x[0-9A-Fa-f]+")
# A common alternation for how vocabularies of this family cut texts before merging.
_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The vocabulary as an encoder, built once in each Python worker."""
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("scan", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})


def is_random(run: str, before: str, path: str, most: float) -> bool:
    """Whether a run of key characters is neither a word, a name nor a known kind of identifier."""
    digits, upper, lower = (any(map(f, run)) for f in (str.isdigit, str.isupper, str.islower))
    if len(run) < LEAST_RUN or digits + upper + lower < 2 or not (upper or lower):
        return False
    if _HEX_ONLY.fullmatch(run) or _UUID.fullmatch(run) or _DIGEST_NAME.search(before):
        return False
    if not digits and (run[1:].islower() or run.isupper()):
        return False
    return len(run) < most * len(encoder(path).encode_ordinary(run))


def random_parts(run: str, before: str, path: str, most: float) -> list[tuple[int, int]]:
    """Start and end of the random parts of a run of key characters.

    A digest's name exempts what stands right behind it if that has the form of a digest; the rest is tested.
    """
    if _DIGEST_NAME.search(before):
        return []
    out, at = [], 0
    for label in _LABEL.finditer(run):
        if label.start() < at:
            continue
        out += [(at + a, at + e) for a, e in parts_of(run[at:label.start()], before, path, most)]
        value = _DIGEST.match(run, label.end())
        at = value.end() if value else label.end()
    return out + [(at + a, at + e) for a, e in parts_of(run[at:], before, path, most)]


def parts_of(run: str, before: str, path: str, most: float) -> list[tuple[int, int]]:
    """Random parts of a run, or of a piece of it, without a digest's name in it."""
    if is_random(run, before, path, most):
        return [(0, len(run))]
    out, parts = [], [(m.start(), m.end()) for m in _PART.finditer(run)]
    mixed = [not _PLAIN.fullmatch(run[a:e]) for a, e in parts]
    k = 0
    while k < len(parts):
        j = k
        while j < len(parts) and mixed[j]:
            j += 1
        if j > k and is_random(run[parts[k][0]:parts[j - 1][1]], before, path, most):
            out.append((parts[k][0], parts[j - 1][1]))
        else:
            for a, e in parts[k:j]:
                if is_random(run[a:e], before, path, most):
                    out.append((a, e))
                elif not _HEX_ONLY.fullmatch(run[a:e]):
                    hits = [i for i in range(a, e - WINDOW + 1) if is_random(run[i:i + WINDOW], before, path, most)]
                    if hits:
                        out.append((hits[0], hits[-1] + WINDOW))
        k = max(j, k + 1)
    return out


def spans_of(text: str | None, path: str = VOCABULARY, most: float = CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """``start, kind number, end`` of every span of a text, sorted."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    small = text.lower()
    if any(w in small for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    for m in _LONG.finditer(text):
        run, at = m.group(), m.start()
        if "AKIA" in run:
            # an access key ends where its capitals and digits end, inside the run
            found += [(at + k.start(), 1, at + k.end()) for k in _ACCESS.finditer(run)
                      if k.end() - k.start() >= 18]
        found += [(at + k.start(), 2, at + k.end()) for k in _HEX.finditer(run)]
    base, at = joined((a, e) for a, _, e in found), 0
    for m in _LONG.finditer(text):
        start, end = m.start(), m.end()
        while at < len(base) and base[at][1] <= start:
            at += 1
        to = at
        while to < len(base) and base[to][0] < end:
            to += 1
        gone = sorted(base[at:to] + [(start + u.start(), start + u.end()) for u in _UUID.finditer(m.group())])
        for a, e in [*gone, (end, end)]:
            run = text[start:max(start, a)].strip("=-_/+")
            if len(run) >= LEAST_RUN:
                low = text.index(run, start)
                found += [(low + x, 3, low + y) for x, y in random_parts(run, text[max(0, low - 16):low], path, most)]
            start = max(start, e)
    return sorted(found)


def joined(spans) -> list[tuple[int, int]]:
    """Spans that overlap as one, in order."""
    out: list[tuple[int, int]] = []
    for a, e in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, path: str = VOCABULARY, most: float = CHARS_PER_TOKEN) -> DataFrame:
    """``doc_id`` and ``found``, the spans of its text, for every row of ``docs``."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": e} for a, k, e in spans_of(x.as_py(), path, most)]
                     for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, the fingerprint of the pattern spans and all spans as text, from ``scan``."""
    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("found", lambda s: s["kind"] != "random")
    return scanned.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(text(base), 256).alias("base_sha256"),
                          text(F.col("found")).alias("spans"), count("random"))


def masked(text: str | None, spans: list[tuple[int, int, int]], mask: str) -> str | None:
    """The text with every span, or joined run of overlapping spans, replaced."""
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mask: str = "<secret>", path: str = VOCABULARY,
           most: float = CHARS_PER_TOKEN) -> DataFrame:
    """``docs`` with all spans masked; ``n_chars``, where present, follows the text of a changed row."""
    names = docs.columns
    place, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(place)]
            spans = [spans_of(text, path, most) for text in texts]
            hit = [i for i, s in enumerate(spans) if s]
            columns = list(batch.columns)
            if hit:
                for i in hit:
                    texts[i] = masked(texts[i], spans[i], mask)
                columns[place] = pa.array(texts, columns[place].type)
                if size is not None:
                    sizes = columns[size].to_pylist()
                    for i in hit:
                        sizes[i] = len(texts[i])
                    columns[size] = pa.array(sizes, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def fingerprint(spans: list[tuple[int, int, int]]) -> str:
    """The pattern spans' digest, as ``digest`` gives it."""
    return hashlib.sha256(written([s for s in spans if s[1] < 3]).encode()).hexdigest()
