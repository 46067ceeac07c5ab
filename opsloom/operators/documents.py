"""Document jobs: metadata, text, routing, chunks, vectors, tags, categories."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions import parse, text
from opsloom.operators import catalog, joins
from opsloom.operators.select import (embedding_model, processor_by_mime, route_queue)
from opsloom.operators.summary import pool_vectors
from opsloom.session import cut

CHUNK = 8000
KNOWN_TERMS = 50_000   # most frequent terms that each task knows, none longer than KNOWN_BYTES
KNOWN_BYTES = 64
FIRST_SIGN = 48   # cells of term vectors are written as the ASCII signs from here on

# Leading bytes (hex) of known formats.
MAGIC = [("25504446", "application/pdf"), ("89504E470D0A1A0A", "image/png"),
         ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("504B0304", "application/zip"),
         ("494433", "audio/mpeg"), ("1A45DFA3", "video/webm"), ("50415231", "application/x-parquet")]

# Start of an HTML text: marks, blanks, comments and an XML line of any length may stand before it.
HTML_START = r"(?is)\A\x{FEFF}?(?:\s++|<!--.*?-->|<\?xml.*?\?>)*+<(?:!doctype\s+html|html)"


def mime_of(content: Column) -> Column:
    """Mime type from leading bytes; text is told apart by its first tag, wherever that stands."""
    head = F.hex(F.substring(content, 1, 16))
    known = F.coalesce(*[F.when(head.startswith(m), mime) for m, mime in MAGIC])
    return F.coalesce(known, F.when(content.cast("string").rlike(HTML_START), "text/html"),
                      F.lit("text/plain"))


def file_metadata(files: DataFrame) -> DataFrame:
    """Name, extension, size, times, mime and md5 from path, length, modificationTime, content."""
    name = text.basename("path")
    return files.select(
        "path", name.alias("file_name"), text.extension(name).alias("extension"),
        F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"),
        mime_of(F.col("content")).alias("mime_type"), F.md5("content").alias("md5_hash"))


def extract_text(files: DataFrame, content: str = "content", mime: str = "mime_type") -> DataFrame:
    """Plain text as it is, HTML stripped, media NULL."""
    body = F.col(content).cast("string")
    return files.withColumn("text", F.when(F.col(mime) == "text/html", text.html_to_text(body))
                            .when(F.col(mime).startswith("text/")
                                  | (F.col(mime) == "application/pdf"), body))


def route(files: DataFrame) -> DataFrame:
    """Files and bytes per queue, processor and next stage."""
    queue = route_queue(F.col("mime_type"), F.col("priority"), F.col("file_size"))
    return (files.withColumns({"queue": queue, "processor": processor_by_mime(F.col("mime_type"))})
            .withColumn("next_stage", F.when(F.col("queue") == "embeddings_staging", "embedding")
                        .otherwise("storage"))
            .groupBy("queue", "processor", "next_stage")
            .agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes")))


def chunk(docs: DataFrame, n: int = CHUNK, key: str = "file_id", body: str = "text") -> DataFrame:
    """Every ``n`` characters of the whole text; empty text has no chunk."""
    parts = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{n}}}"), F.lit(0))
    count = F.ceil(F.length(body) / n).cast("int")
    return (docs.filter(F.length(body) > 0)
            .select(key, count.alias("chunks"), F.posexplode(parts).alias("pos", "chunk"))
            .select(key, "pos", "chunks", "chunk"))


def term_counts(tokens: str) -> tuple[Column, Column]:
    """Default vector: how many tokens of the column fall into each of ``text.DIMS`` md5 cells.

    Gives the expression of column ``_signs`` and, over that column, the counts. Every cell is a sign; the tokens become one string of signs, and counting one is a string
    operation instead of a pass over the tokens.
    """
    signs = F.array_join(F.transform(tokens, lambda w: F.char(
        F.pmod(text.hash_number(w), F.lit(text.DIMS)) + FIRST_SIGN)), "")
    counts = F.transform(F.array(*[F.lit(chr(FIRST_SIGN + d)) for d in range(text.DIMS)]),
                         lambda c: F.length("_signs") - F.length(F.replace(F.col("_signs"), c, F.lit(""))))
    return signs, counts.cast("array<double>")


def embed(docs: DataFrame, cache: DataFrame | None = None, now=None,
          vectorise: Callable[[Sequence[str]], np.ndarray] | None = None,
          batch: int = 32, n: int = CHUNK) -> DataFrame:
    """Vectors per (model, md5_hash), computed only for contents the cache does not hold.

    ``docs`` has model, md5_hash, text. Copies of one content are embedded once. By default a chunk's
    vector is its term counts, computed without Python; a vectoriser gets lists of at most ``batch``
    chunks instead. Chunk vectors are averaged and normalised.
    """
    todo = docs.groupBy("model", "md5_hash").agg(F.any_value("text").alias("text"))
    hits = None
    if cache is not None:
        looked = joins.cache_lookup(todo, cache, now)
        hits = looked.filter("hit").select("model", "md5_hash", F.col("value").alias("embedding"))
        todo = looked.filter("NOT hit").drop("hit", "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at:at + batch]
                yield part[["model", "md5_hash"]].assign(
                    embedding=list(vectorise(part["chunk"].tolist())))

    pieces = chunk(todo.withColumn("_k", F.struct("model", "md5_hash")), n, "_k").select(
        "_k.*", "chunk")
    if vectorise is None:
        signs, counts = term_counts("_w")
        worded = pieces.select("model", "md5_hash", text.words("chunk").alias("_w"))
        vectors = (worded.select("model", "md5_hash", signs.alias("_signs"))
                   .select("model", "md5_hash", counts.alias("embedding")))
    else:
        vectors = pieces.mapInPandas(run, "model string, md5_hash string, embedding array<double>")
    pooled = (pool_vectors(vectors.select(F.struct("model", "md5_hash").alias("_k"), "embedding"),
                           "_k").select("_k.*", "embedding"))
    return pooled if hits is None else hits.unionByName(pooled)


# Prompt texts and how many characters of the content the head form of each carries.
PROMPTS = {
    "title": ("Create a concise, descriptive title for this document in 10 words or less: ", 1000),
    "summary": ("Summarize the following text in 2-3 sentences: ", 2000),
    "tags": ("Generate 5-10 relevant tags for this content, separated by commas: ", 2000),
    "entities": ("Extract important entities (people, organizations, locations) from this text "
                 "as a JSON array: ", 2000),
    "language": ("Identify the language of this text, respond with just the ISO language code: ",
                 500),
}


def prompts(docs: DataFrame, key: str = "file_id", body: str = "text",
            heads: bool = False) -> DataFrame:
    """Prompts per document and task with their cache keys.

    A model prompt has a size limit, so a long text gives one prompt for each numbered chunk (D04);
    ``heads`` carries the head of the text only, in one prompt. Empty texts have no chunk to ask
    about.
    """
    pieces = (docs.select(key, F.lit(0).alias("pos"), F.col(body).alias("chunk")) if heads
              else chunk(docs, CHUNK, key, body))
    cells = [F.struct(F.lit(task).alias("task"), F.concat(
        F.lit(head), F.left("chunk", F.lit(size)) if heads else F.col("chunk"),
        F.lit("...") if heads else F.lit("")).alias("prompt"))
        for task, (head, size) in PROMPTS.items()]
    return pieces.select(key, F.col("pos").alias("part"), F.inline(F.array(*cells))).withColumn(
        "cache_key", F.concat_ws(":", "task", F.md5("prompt")))


def parse_responses(resp: DataFrame, body: str = "response") -> DataFrame:
    """Adds the parsed form that fits each ``task``."""
    t, answer = F.col("task"), F.col(body)
    graded = parse.category_confidence(answer)
    return resp.withColumns({
        "value": F.when(t.isin("title", "summary", "language"), F.trim(answer)),
        "tags": F.when(t == "tags", parse.comma_list(answer)),
        "category": F.when(t == "category", graded["category"]),
        "confidence": F.when(t == "category", graded["confidence"]),
        "entities": F.when(t == "entities", parse.entities(answer))})


def tags(docs: DataFrame, k: int = 10, key: str = "file_id", body: str = "text",
         min_length: int = 3) -> DataFrame:
    """The ``k`` terms with the highest tf-idf per document.

    A text's terms are counted where it is read and written as one row. Only terms that can be among the best of
    their document travel to their document frequency: the most frequent ones are known to each task, the others are
    at most as frequent as the last of these, which bounds every score from both sides. Rows of one key count as one
    document; only keys with several rows are grouped.
    """
    kind = dict(docs.dtypes)[key]
    long_enough = F.filter(text.words(body), lambda w: F.length(w) >= min_length)
    counted = cut(docs.select(key, F.array_join(long_enough, " ").cast("binary").alias("words")).mapInArrow(
        count_terms, f"{key} {kind}, terms array<string>, tf array<int>"), "terms")
    several = cut(counted.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        F.col(key).alias("_k")), "several")
    merged = None
    if not several.isEmpty():
        same = F.col(key).eqNullSafe(F.col("_k"))
        merged = cut(counted.join(several, same, "left_semi").select(key, F.inline(F.arrays_zip("terms", "tf"))).groupBy(
            key, F.col("terms").alias("term")).agg(F.sum("tf").cast("int").alias("tf")), "merged")
        counted = counted.join(several, same, "left_anti")
    each = counted.select(F.explode("terms").alias("term"))
    if merged is not None:
        each = each.unionByName(merged.select("term"))
    df = cut(each.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    total = docs.count()
    known = df.filter(F.octet_length("term") <= KNOWN_BYTES).orderBy(F.desc("df"), "term").limit(KNOWN_TERMS).toArrow()
    tf = counted.mapInArrow(possible_tags(docs.sparkSession.sparkContext.broadcast(known), total, k),
                            f"{key} {kind}, term string, tf int")
    if merged is not None:
        tf = tf.unionByName(merged)
    score = F.round(F.col("tf") * F.log(F.lit(total + 1).cast("long") / (F.col("df") + 1)), 9)
    best = Window.partitionBy(key).orderBy(F.desc("score"), "term")
    return (tf.join(df, "term").withColumn("score", score)
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select(key, "term", "score", "rank"))


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: the distinct terms of a key's words and how often each stands there."""
    for b in batches:
        counts = [Counter(words.split(b" ")) if words else {} for words in b["words"].to_pylist()]
        terms = pa.array([[*c] for c in counts], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([b.column(0), terms, pa.array([[*c.values()] for c in counts], pa.list_(pa.int32()))],
                                         names=[b.schema.names[0], "terms", "tf"])


def possible_tags(known, total: int, k: int):
    """For ``mapInArrow`` over ``key, terms, tf``: the terms that may be among the best ``k`` of their key.

    ``known`` is a broadcast table of the most frequent terms. A term that is not in it is in one document at least
    and in no more than the last one there; a term too long for it may be in all.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, df = known.value["term"].combine_chunks(), known.value["df"].to_numpy()
        for b in batches:
            terms, tf = b["terms"].flatten(), b["tf"].flatten().to_numpy()
            at = pc.fill_null(pc.index_in(terms, value_set=names), -1).to_numpy()
            fewest, most = np.ones(len(at)), np.full(len(at), float(df[-1] if len(df) else total))
            most[pc.greater(pc.binary_length(terms), KNOWN_BYTES).to_numpy(zero_copy_only=False)] = total
            fewest[at >= 0] = most[at >= 0] = df[at[at >= 0]]
            low, high = (tf * np.log((total + 1) / (n + 1)) for n in (most, fewest))
            lengths = b["terms"].value_lengths().to_numpy()
            ends = np.cumsum(lengths)
            # Rounding of the scores is far below the margin.
            cuts = np.array([np.partition(low[e - n:e], n - k)[n - k] - 1e-6 if n > k else -np.inf
                             for e, n in zip(ends, lengths)])
            kept = pa.array(np.flatnonzero(high >= np.repeat(cuts, lengths)))
            rows = pa.array(np.repeat(np.arange(b.num_rows), lengths)).take(kept)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), terms.take(kept), pa.array(tf).take(kept)],
                                             names=[b.schema.names[0], "term", "tf"])
    return run


def categorise(docs: DataFrame, lexicon: Mapping[str, list[str]], key: str = "file_id",
               body: str = "text") -> DataFrame:
    """Category with most keyword hits and its share of all hits; no hit gives (NULL, 0).

    The lexicon is part of the expression, so nothing is joined or shuffled.
    """
    counted = docs.select(key, text.words(body).alias("_w")).select(
        key, F.array(*[F.struct(text.count_in(F.col("_w"), terms).alias("hits"),
                                F.lit(-i).alias("_o"), F.lit(name).alias("name"))
                       for i, (name, terms) in enumerate(sorted(lexicon.items()))]).alias("_c"))
    total = F.aggregate("_c", F.lit(0), lambda a, c: a + c["hits"])
    best = F.array_max("_c")
    return counted.select(
        key, F.when(best["hits"] > 0, best["name"]).alias("category"),
        F.when(total > 0, best["hits"] / total).otherwise(F.lit(0.0)).alias("confidence"))


# Frequent words per language.
STOP_WORDS = {
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf", "für", "ist",
           "nicht", "dem", "im", "ein", "eine", "als", "auch", "es"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with",
           "be", "by", "as", "this", "are", "at", "from"],
    "es": ["el", "la", "que", "en", "y", "los", "se", "del", "las", "por", "un", "no", "con",
           "su", "una", "es", "para", "al", "lo", "como"],
    "fr": ["le", "la", "et", "les", "des", "en", "un", "du", "une", "que", "pour", "est", "qui",
           "par", "dans", "sur", "au", "pas", "avec", "ce"],
}


def detect_language(docs: DataFrame, key: str = "file_id", body: str = "text") -> DataFrame:
    """Language whose stop words cover the largest share of the words; NULL without any."""
    scored = categorise(docs, STOP_WORDS, key, body)
    return scored.withColumnRenamed("category", "language")


def moderate(docs: DataFrame, toxic: list[str], positive: list[str], negative: list[str],
             key: str = "file_id", body: str = "text") -> DataFrame:
    """Moderation and sentiment by lexicon; sentiment lies in [-1, 1]."""
    w = F.col("_w")
    return docs.select(key, text.words(body).alias("_w")).select(
        key, text.count_in(w, toxic).alias("toxic_hits"),
        (text.count_in(w, positive) - text.count_in(w, negative)).alias("_d"),
        (text.count_in(w, positive) + text.count_in(w, negative)).alias("_s")).select(
        key, "toxic_hits", (F.col("toxic_hits") > 0).alias("flagged"),
        F.when(F.col("_s") > 0, F.col("_d") / F.col("_s")).otherwise(F.lit(0.0)).alias("sentiment"))


# ISO, dotted and slashed dates; mail addresses and salutations.
DATE_PATTERN = r"(?:^|[^0-9])(\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?:[^0-9]|$)"
MAIL_PATTERN = r"([A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.]*[A-Za-z0-9])"


def extract_fields(docs: DataFrame, key: str = "file_id", body: str = "text") -> DataFrame:
    """Dates and correspondents (mail addresses) anywhere in the text."""
    return docs.select(key, F.regexp_extract_all(body, F.lit(DATE_PATTERN), 1).alias("dates"),
                       F.array_distinct(F.regexp_extract_all(body, F.lit(MAIL_PATTERN), 1))
                       .alias("correspondents"))


def reassemble(lines: DataFrame, by: Sequence[str], order: str, line: str = "line") -> DataFrame:
    """Streamed lines of one response joined in order (a response has a token limit)."""
    pieces = lines.withColumn("_p", parse.stream_piece(F.col(line))).filter("_p IS NOT NULL")
    packed = pieces.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, "_p"))).alias("_l"))
    return packed.select(*by, F.array_join(F.transform("_l", lambda s: s["_p"]), "").alias("text"))


def with_errors(df: DataFrame, key: str, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every check, and one error row per failed check."""
    failed = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name))
                                       for name, bad in checks.items()]))
    marked = df.withColumn("_errors", failed)
    good = marked.filter(F.size("_errors") == 0).drop("_errors")
    errors = marked.select(key, F.explode("_errors").alias("error"))
    return good, errors


def enrich(files: DataFrame, lexicon: Mapping[str, list[str]]) -> DataFrame:
    """D01-D10 and D13 for one table of files with text: one narrow plan, no shuffle."""
    w = F.col("_w")

    def winner(lists):
        return F.array_max(F.array(*[F.struct(text.count_in(w, terms).alias("hits"),
                                              F.lit(-i).alias("_o"), F.lit(name).alias("name"))
                                     for i, (name, terms) in enumerate(sorted(lists.items()))]))

    best = files.withColumn("_w", text.words("text")).withColumns(
        {"_cat": winner(lexicon), "_lang": winner(STOP_WORDS)})
    return (best.withColumns({
        "queue": route_queue(F.col("mime_type"), F.col("priority"), F.col("file_size")),
        "model": embedding_model(F.col("mime_type")),
        "dewey_decimal": parse.dewey(F.col("text")),
        "categories": F.array_compact(F.array(F.when(F.col("_cat.hits") > 0, F.col("_cat.name")))),
        "language": F.when(F.col("_lang.hits") > 0, F.col("_lang.name")),
        "chunk_count": F.ceil(F.length("text") / CHUNK)}).drop("_w", "_cat", "_lang"))


def run_documents(files: DataFrame, lexicon: Mapping[str, list[str]]) -> dict[str, DataFrame]:
    """Enrich once, write that table to the shared folder, derive every target from it."""
    good, errors = with_errors(files, "file_id", {"empty text": F.length("text") == 0})
    done = cut(enrich(good, lexicon), "documents")
    points = done.withColumns({
        "finished_at": F.timestamp_micros(F.unix_micros("created_at") + F.col("file_size") * 1000),
        "error": F.lit(None).cast("string")})
    return {"enriched": done, "errors": errors, **catalog.build_catalog(done),
            **catalog.graph_tables(done), "search_docs": catalog.search_docs(done),
            "cache": catalog.cache_rows(done), "points": catalog.lifecycle_points(points)}
