"""Keyword, filtered vector and hybrid search."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsloom.functions import text
from opsloom.operators.ordered import row_index
from opsloom.operators.vectors import knn
from opsloom.session import small_table

# Searched fields in rank order, shortest word that may hold a typo.
FIELDS = ["title", "file_name", "summary", "tags", "categories", "dewey_decimal"]
MIN_TYPO_SIZE = 3
# Distance of words that do not meet in any field: more than any text has words.
APART = 1 << 31


def postings(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "id") -> DataFrame:
    """(term, field_rank, doc, pos) rows; array fields are joined with blanks."""
    types = dict(docs.dtypes)
    bodies = []
    for rank, field in enumerate(fields):
        if field not in types:
            continue
        body = F.array_join(field, " ") if types[field].startswith("array") else F.col(field)
        bodies.append(F.struct(F.lit(rank).alias("field_rank"), body.alias("body")))
    rows = docs.select(F.col(key).alias("doc"), F.inline(F.array(*bodies)))
    tokens = F.filter(F.split(F.lower("body"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return rows.select("doc", "field_rank", F.posexplode(tokens).alias("pos", "term"))


def query_words(query: str) -> list[str]:
    import regex
    return list(dict.fromkeys(w for w in regex.split(r"[^\p{L}\p{N}]+", query.lower()) if w))


def matching_terms(idx: DataFrame, words: Sequence[str]) -> DataFrame:
    """Vocabulary terms within one edit of a query word (exact only for short words).

    Levenshtein runs over distinct terms of nearly the same length, never over postings.
    """
    vocabulary = idx.select("term").distinct()
    cells = F.array(*[F.struct(F.lit(i).alias("word_no"), F.lit(w).alias("word"))
                      for i, w in enumerate(words)])
    pairs = vocabulary.select("term", F.inline(cells))
    near = (F.abs(F.length("term") - F.length("word")) <= 1) & (
        F.length("word") >= MIN_TYPO_SIZE)
    typos = F.when(F.col("term") == F.col("word"), 0).when(
        near & (F.levenshtein("term", "word", 1) == 1), 1)
    return pairs.withColumn("typos", typos).filter("typos IS NOT NULL").select(
        "term", "word_no", "typos")


# ---------------------------------------------------------------- stored postings

def one_less(word: str) -> list[str]:
    """The word and what is left of it without one character: words within one edit share one of these."""
    return list(dict.fromkeys([word, *(word[:i] + word[i + 1:] for i in range(len(word)))]))


@dataclass
class Index:
    """Postings by term and the deletion neighbourhoods of all terms, written once and read by the buckets of a query."""

    spark: SparkSession
    root: str
    buckets: int

    def read(self, part: str, column: str, wanted: Sequence[str]) -> DataFrame:
        """Rows of a part whose ``column`` is one of the wanted strings; only their buckets are read."""
        table = self.spark.read.parquet(f"{self.root}/{part}")
        if not wanted:
            return table.limit(0)
        names = small_table(self.spark, "name STRING", [(w,) for w in wanted])
        at = names.select(bucket_of(F.col("name"), self.buckets).alias("b")).distinct().collect()
        return table.filter(F.col("bucket").isin([r["b"] for r in at]) & F.col(column).isin(list(wanted)))

    def terms(self, words: Sequence[str]) -> DataFrame:
        """``term, word_no, typos`` as ``matching_terms``, by an equal join of deletion neighbourhoods."""
        variants = [(i, w, v) for i, w in enumerate(words) for v in (one_less(w) if len(w) >= MIN_TYPO_SIZE else [w])]
        if not variants:
            return self.spark.createDataFrame([], "term STRING, word_no INT, typos INT")
        asked = small_table(self.spark, "word_no INT, word STRING, variant STRING", variants)
        found = self.read("terms", "variant", sorted({v for _, _, v in variants})).join(F.broadcast(asked), "variant")
        typos = F.when(F.col("term") == F.col("word"), 0).when(
            (F.length("word") >= MIN_TYPO_SIZE) & (F.levenshtein("term", "word", 1) == 1), 1)
        return found.select("term", "word_no", typos.alias("typos")).filter("typos IS NOT NULL").distinct()

    def hits(self, words: Sequence[str]) -> DataFrame:
        """Postings of the terms within one edit of a query word, whose number the length of the words bounds."""
        near = self.terms(words).collect()
        terms = small_table(self.spark, "term STRING, word_no INT, typos INT", [tuple(r) for r in near]) if near else (
            self.terms([]))
        rows = self.read("postings", "term", sorted({r["term"] for r in near})).select("term", "doc", "field_rank", "pos")
        return rows.join(F.broadcast(terms), "term")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_index(docs: DataFrame, root: str, fields: Sequence[str] = FIELDS, key: str = "id",
                buckets: int = 64) -> Index:
    """Write postings and deletion neighbourhoods, each in ``buckets`` folders by a hash of what they are looked up by.

    Within a bucket rows are sorted, so that a reader skips most of it; a bucket is written by as many tasks as have
    rows for it, so a term in every document is not one task.
    """
    idx = postings(docs, fields, key).withColumn("bucket", bucket_of(F.col("term"), buckets))
    part = F.pmod(F.xxhash64("doc"), F.lit(8))
    (idx.repartition("bucket", part).sortWithinPartitions("bucket", "term", "doc").write.partitionBy("bucket")
     .mode("overwrite").parquet(f"{root}/postings"))
    spark = docs.sparkSession
    terms = spark.read.parquet(f"{root}/postings").select("term").distinct()
    less = F.transform(F.sequence(F.lit(1), F.length("term")), lambda i: F.concat(
        F.substring("term", F.lit(1), i - 1), F.substr("term", i + 1)))
    variants = terms.select("term", F.explode(F.array_distinct(F.concat(F.array("term"), less))).alias("variant"))
    (variants.withColumn("bucket", bucket_of(F.col("variant"), buckets)).repartition("bucket")
     .sortWithinPartitions("bucket", "variant").write.partitionBy("bucket").mode("overwrite").parquet(f"{root}/terms"))
    return Index(spark, root, buckets)


def search(docs: DataFrame, query: str, filters: Column | str | None = None,
           sort: Sequence[str] = (), fields: Sequence[str] = FIELDS, key: str = "id",
           limit: int | None = None, offset: int = 0, cap: int | None = None,
           far: int | None = None, index: Index | None = None) -> DataFrame:
    """Ranked hits, all of them unless ``limit`` asks for a page.

    Rules in order: query words found, typos, proximity of neighbouring query words, best field,
    ``sort`` columns (a leading minus sorts descending), exactly matched words. ``cap`` ends the
    result after so many hits, as the page limit of an index does, and ``far`` treats greater
    distances as equal; both are off by default. A page past the end is empty. Ranking carries ids,
    rule values and sort columns only; the documents themselves are joined to the page of hits. With an ``index`` of the
    documents no text is read for the ranking, only the postings of matching terms.
    """
    kept = docs if filters is None else docs.filter(filters)
    words = query_words(query)
    if index is None:
        idx = postings(kept, fields, key)
        hits = idx.join(matching_terms(idx, words), "term")
    else:
        hits = index.hits(words)
        if filters is not None:
            hits = hits.join(kept.select(F.col(key).alias("doc")), "doc", "left_semi")
    # Nearest earlier hit of each word in the same field: one ordered pass per document field.
    lane = Window.partitionBy("doc", "field_rank").orderBy("pos", "word_no").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    seen = {f"_p{i}": F.last(F.when(F.col("word_no") == i, F.col("pos")), ignorenulls=True).over(lane)
            for i in range(len(words))}
    placed = hits.withColumns(seen)
    gaps = []
    for i in range(len(words) - 1):
        here = F.col("word_no").isin(i, i + 1)
        most = F.lit(APART if far is None else far)
        gaps.append(F.least(most, F.coalesce(F.min(F.when(here, F.abs(
            F.col(f"_p{i}") - F.col(f"_p{i + 1}")))), most)).cast("long").alias(f"_g{i}"))
    best = [F.min(F.when(F.col("word_no") == i, F.col("typos"))).alias(f"_t{i}")
            for i in range(len(words))]
    places = placed.groupBy("doc").agg(F.min("field_rank").alias("attribute"), *gaps, *best)
    typo_cols = [F.col(f"_t{i}") for i in range(len(words))]
    places = places.withColumns({
        "words": sum((t.isNotNull().cast("long") for t in typo_cols), F.lit(0).cast("long")),
        "typos": sum((F.coalesce(t, F.lit(0)).cast("long") for t in typo_cols), F.lit(0).cast("long")),
        "exact": sum((F.coalesce((t == 0).cast("long"), F.lit(0)) for t in typo_cols),
                     F.lit(0).cast("long"))})
    proximity = sum((F.col(f"_g{i}") for i in range(len(gaps))), F.lit(0).cast("long"))
    names = [c.lstrip("-") for c in sort]
    by = [F.desc(f"_s_{c[1:]}") if c.startswith("-") else F.asc(f"_s_{c}") for c in sort]
    order = [F.desc("words"), "typos", "proximity", "attribute", *by, F.desc("exact"), "doc"]
    rules = places.select("doc", "words", "typos", proximity.alias("proximity"), "attribute", "exact")
    if names:
        keys = kept.select(F.col(key).alias("doc"), *[F.col(c).alias(f"_s_{c}") for c in names])
        rules = rules.join(keys, "doc")
    sizes = [n for n in (limit, None if cap is None else max(cap - offset, 0)) if n is not None]
    page = rules
    if offset or sizes:
        page = rules.orderBy(*order).offset(offset)
        page = page.limit(min(sizes)) if sizes else page
    ranked = page.join(kept.withColumnRenamed(key, "doc"), "doc").orderBy(*order)
    return ranked.select(F.col("doc").alias(key), "words", "typos", "proximity", "attribute", "exact",
                         *[c for c in kept.columns if c not in (key, "words")])


def vector_search(docs: DataFrame, queries: DataFrame, k: int, filters: Column | str | None = None,
                  metric: str = "cosine", recall: float | None = None) -> DataFrame:
    """Nearest vectors among the documents that pass the filter, all of them or a share of about ``recall``."""
    kept = docs if filters is None else docs.filter(filters)
    return knn(queries, kept.select(F.col("id").alias("base_id"), "embedding"), k, metric, recall=recall)


def hybrid(keyword_hits: DataFrame, vector_hits: DataFrame, k: int, depth: int = 60) -> DataFrame:
    """Merge two ranked lists of (id, rank) by the sum of 1 / (depth + rank).

    Both lists compete in full; ``k`` cuts the merged one only.
    """
    both = keyword_hits.select("id", "rank").unionByName(vector_hits.select("id", "rank"))
    return (both.groupBy("id").agg(F.round(F.sum(1 / (depth + F.col("rank"))), 9).alias("score"))
            .orderBy(F.desc("score"), "id").limit(k))


def numbered(hits: DataFrame, order: Sequence[str], coarse: Sequence[str]) -> DataFrame:
    """Rank of every hit under ``order``, ascending columns of which ``coarse`` are the first.

    Hits are ranked within equal values of ``coarse`` and these are added up, so a long list is never
    sorted by one task unless all its hits agree on them.
    """
    one = hits.withColumns({"_all": F.lit(0), "_coarse": F.struct(*coarse)})
    ranked = row_index(one, ["_all"], order, F.col("_coarse"), "_at")
    return ranked.withColumn("rank", F.col("_at") + 1).drop("_all", "_coarse", "_at")
