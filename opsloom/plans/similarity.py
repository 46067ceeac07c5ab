"""J12, J14, D11, D12, D16, D17, T03 on the supplied tables."""

from pyspark.sql import functions as F

from opsloom import model
from opsloom.model import FILES_SQL
from opsloom.operators import catalog, graph, search, similar, summary
from opsloom.operators import vectors as near
from opsloom.plans.documents import WORDS_SQL
from opsloom.plans.registry import query
from opsloom.plans.state_quality import files_with_entities
from opsloom.session import fresh_dir


def vectors(spark, d, name):
    return model.table(spark, d, "embeddings").select(F.col("vec_id").alias(name), "embedding")


@query("j12_knn_l2", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS base_id, list_distance(a.e, b.e) AS distance
  FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), base_id) AS rank FROM p)
SELECT query_id, base_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5""")
def j12(spark, d):
    return near.knn(vectors(spark, d, "query_id"), vectors(spark, d, "base_id"), 5).withColumn(
        "distance", F.round("distance", 6))


@query("j12_knn_cosine", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS base_id, 1 - list_cosine_similarity(a.e, b.e) AS distance
  FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), base_id) AS rank FROM p)
SELECT query_id, base_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5""")
def j12b(spark, d):
    out = near.knn(vectors(spark, d, "query_id"), vectors(spark, d, "base_id"), 5, "cosine",
                   block_bytes=1 << 15)
    return out.withColumn("distance", F.round("distance", 6))


@query("j12_knn_probes")
def j12c(spark, d):
    """As many cells a query as find 19 of 20 neighbours: SQL can't say which, the recall is tested."""
    out = near.knn(vectors(spark, d, "query_id"), vectors(spark, d, "base_id"), 5, recall=0.95)
    return out.withColumn("distance", F.round("distance", 6))


RELATED_VECTORS_SQL = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
f AS MATERIALIZED (SELECT e, min(vec_id) AS id FROM v GROUP BY 1)
SELECT f.id AS src, vec_id AS dst, 1.0::DOUBLE AS score FROM v JOIN f USING (e) WHERE vec_id > f.id
UNION ALL SELECT a.id, b.id, round(list_cosine_similarity(a.e, b.e), 6) FROM f a JOIN f b ON a.id < b.id
  AND round(list_cosine_similarity(a.e, b.e), 9) >= 0.4"""


@query("d11_related_vectors", RELATED_VECTORS_SQL)
def d11v(spark, d):
    return near.related_vectors(vectors(spark, d, "id"), 0.4, recall=None, planes=4).withColumn(
        "score", F.round("score", 6))


SHINGLE_SQL = f"""s AS (SELECT id, list_distinct(list_transform(CASE WHEN len(w) >= 3
  THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
  ELSE [array_to_string(w, ' ')] END,
  lambda t: CAST(concat('0x', substring(md5(t), 1, 8)) AS BIGINT) % {similar.PRIME})) AS set
  FROM (SELECT min(doc_id) AS id, {WORDS_SQL} AS w FROM documents GROUP BY text))"""

@query("d11_related", f"""WITH {SHINGLE_SQL}, e AS MATERIALIZED (SELECT id, len(set) AS n, unnest(set) AS h FROM s),
j AS (SELECT a.id AS src, b.id AS dst, count(*) AS n, any_value(a.n) + any_value(b.n) AS t
  FROM e a JOIN e b ON a.h = b.h AND a.id < b.id GROUP BY 1, 2),
c AS (SELECT min(doc_id) OVER (PARTITION BY text) AS src, doc_id AS dst FROM documents)
SELECT src, dst, round(n / (t - n), 6) AS score FROM j WHERE n / (t - n) >= 0.6
UNION ALL SELECT src, dst, 1.0 FROM c WHERE src < dst""")
def d11(spark, d):
    return similar.related(model.files(spark, d).select("file_id", "text"), 0.6).withColumn(
        "score", F.round("score", 6))


@query("d11_classes", f"""WITH RECURSIVE {SHINGLE_SQL}, e AS MATERIALIZED (SELECT id, len(set) AS n, unnest(set) AS h FROM s),
j AS MATERIALIZED (SELECT src, dst FROM (SELECT a.id AS src, b.id AS dst, count(*) AS n,
  any_value(a.n) + any_value(b.n) AS t FROM e a JOIN e b ON a.h = b.h AND a.id <> b.id GROUP BY 1, 2)
  WHERE n / (t - n) >= 0.6),
reach AS (SELECT id, id AS other FROM s UNION SELECT r.id, j.dst FROM reach r JOIN j ON r.other = j.src),
c AS (SELECT id, min(other) AS class_id FROM reach GROUP BY 1),
f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS id FROM documents)
SELECT doc_id AS file_id, class_id, count(*) OVER (PARTITION BY class_id) AS members FROM f JOIN c USING (id)""")
def d11b(spark, d):
    return similar.related_classes(model.files(spark, d).select("file_id", "text"), 0.6)[0]


@query("d12_phash_pairs", f"""WITH w AS (SELECT doc_id, unnest({WORDS_SQL}) AS w FROM documents),
c AS (SELECT doc_id, CAST(concat('0x', substring(md5(w), 1, 8)) AS BIGINT) % 64 AS cell,
  count(*) AS n FROM w GROUP BY 1, 2),
a AS (SELECT doc_id, map_from_entries(list((cell, n))) AS m, sum(n) AS t FROM c GROUP BY 1),
h AS MATERIALIZED (SELECT d.doc_id, CASE WHEN t IS NULL THEN repeat('0', 64) ELSE array_to_string(
  list_transform(range(64), lambda i: CASE WHEN coalesce(m[i], 0) * 64 > t THEN '1' ELSE '0' END), '')
  END AS bits FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id),
f AS MATERIALIZED (SELECT bits, min(doc_id) AS first FROM h GROUP BY 1)
SELECT f.first AS a, h.doc_id AS b, 0 AS distance FROM h JOIN f USING (bits) WHERE h.doc_id > f.first
UNION ALL SELECT x.first, y.first, hamming(x.bits, y.bits) FROM f x JOIN f y ON x.first < y.first
WHERE hamming(x.bits, y.bits) <= 5""")
def d12(spark, d):
    return similar.phash_pairs(similar.average_hash(model.files(spark, d)), 5)


def search_table(spark, d):
    """Documents with the first sentence as title and the whole text as summary."""
    f = model.files(spark, d)
    return f.select(F.col("file_id").alias("id"),
                    F.split_part("text", F.lit("."), F.lit(1)).alias("title"), "file_name",
                    F.col("text").alias("summary"), F.array("lang", "source").alias("tags"),
                    "file_size", "lang")


QUERY = "whose tion ertion and"
SEARCH_SQL = f"""WITH d AS (SELECT doc_id AS id, n_chars AS file_size, lang,
  [split_part(text, '.', 1), NULL, text, lang || ' ' || source] AS bodies FROM documents
  WHERE n_chars > 100 AND lang <> 'de'),
b AS (SELECT id, unnest(range(4)) AS field_rank, unnest(bodies) AS body FROM d),
f AS (SELECT id, field_rank, list_filter(string_split_regex(lower(body), '[^\\p{{L}}\\p{{N}}]+'),
  lambda w: w <> '') AS w FROM b WHERE body IS NOT NULL),
idx AS (SELECT id, field_rank, unnest(range(len(w))) AS pos, unnest(w) AS term FROM f),
q AS (SELECT unnest(range(4)) AS word_no, unnest(['whose','tion','ertion','and']) AS word),
voc AS (SELECT term, word_no, CASE WHEN term = word THEN 0 ELSE 1 END AS typos
  FROM (SELECT DISTINCT term FROM idx) JOIN q ON abs(length(term) - length(word)) <= 1
  AND levenshtein(regexp_replace(term, '[^a-z]', '?', 'g'), word) <= 1),
h AS (SELECT idx.*, word_no, typos FROM idx JOIN voc USING (term)),
p AS (SELECT *, last_value(CASE WHEN word_no = 0 THEN pos END IGNORE NULLS) OVER w AS p0,
  last_value(CASE WHEN word_no = 1 THEN pos END IGNORE NULLS) OVER w AS p1,
  last_value(CASE WHEN word_no = 2 THEN pos END IGNORE NULLS) OVER w AS p2,
  last_value(CASE WHEN word_no = 3 THEN pos END IGNORE NULLS) OVER w AS p3
  FROM h WINDOW w AS (PARTITION BY id, field_rank ORDER BY pos, word_no ROWS UNBOUNDED PRECEDING)),
a AS (SELECT id, min(field_rank) AS attribute,
  coalesce(min(CASE WHEN word_no IN (0, 1) THEN abs(p0 - p1) END), 2147483648) +
  coalesce(min(CASE WHEN word_no IN (1, 2) THEN abs(p1 - p2) END), 2147483648) +
  coalesce(min(CASE WHEN word_no IN (2, 3) THEN abs(p2 - p3) END), 2147483648) AS proximity FROM p GROUP BY 1),
m AS (SELECT id, word_no, min(typos) AS typos FROM h GROUP BY 1, 2),
k AS (SELECT id, count(*) AS words, sum(typos)::BIGINT AS typos, count(*) FILTER (typos = 0) AS exact FROM m GROUP BY 1),
hits AS (SELECT id, words, typos, proximity, attribute, exact, file_size FROM k JOIN a USING (id) JOIN d USING (id)
)"""


@query("d16_search", SEARCH_SQL + """ SELECT id, words, typos, proximity,
  CASE attribute WHEN 1 THEN 1 ELSE attribute END AS attribute, exact, file_size FROM hits""")
def d16(spark, d):
    return run_search(spark, d)


def run_search(spark, d, **page):
    table = search_table(spark, d).drop("file_name")
    return search.search(table, QUERY, "file_size > 100 AND lang <> 'de'", ["-file_size"],
                         **page).select("id", "words", "typos", "proximity", "attribute", "exact",
                                        "file_size")


@query("d16_search_index", SEARCH_SQL + """ SELECT id, words, typos, proximity, attribute, exact, file_size FROM hits""")
def d16b(spark, d):
    """The same search over stored postings."""
    table = search_table(spark, d).drop("file_name")
    return run_search(spark, d, index=search.build_index(table, fresh_dir(spark, "postings"), buckets=16))


@query("t03_search_page", SEARCH_SQL + """ SELECT id, words, typos FROM hits
ORDER BY words DESC, typos, proximity, attribute, file_size DESC, exact DESC, id LIMIT 20 OFFSET 40""")
def t03(spark, d):
    return run_search(spark, d, limit=20, offset=40).select("id", "words", "typos")


@query("d17_vector_search", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS base_id, 1 - list_cosine_similarity(a.e, b.e) AS distance
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND b.label < 5),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), base_id) AS rank FROM p)
SELECT query_id, base_id, rank FROM r WHERE rank <= 3""")
def d17(spark, d):
    docs = model.table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return search.vector_search(docs, vectors(spark, d, "query_id"), 3, "label < 5").select(
        "query_id", "base_id", "rank")


@query("d17_hybrid", SEARCH_SQL + """, kw AS (SELECT id, row_number() OVER (ORDER BY words DESC, typos,
  proximity, attribute, file_size DESC, exact DESC, id) AS rank FROM hits),
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
seed AS (SELECT list(m ORDER BY pos) AS e FROM (SELECT pos, avg(x) AS m FROM (
  SELECT unnest(range(len(e))) AS pos, unnest(e) AS x FROM v) GROUP BY pos)),
dist AS (SELECT b.vec_id AS id, 1 - list_cosine_similarity(a.e, b.e) AS distance FROM seed a, v b),
vr AS (SELECT id, row_number() OVER (ORDER BY round(distance, 9), id) AS rank FROM dist
  ORDER BY rank LIMIT 100)
SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM kw UNION ALL SELECT * FROM vr)
GROUP BY id ORDER BY score DESC, id LIMIT 50""")
def d17b(spark, d):
    hits = run_search(spark, d).withColumns({"more_words": -F.col("words"), "larger": -F.col("file_size"),
                                             "more_exact": -F.col("exact")})
    coarse = ["more_words", "typos", "proximity", "attribute"]
    kw = search.numbered(hits, [*coarse, "larger", "more_exact", "id"], coarse)
    # The query vector is the direction of the whole collection.
    seed = summary.pool_vectors(vectors(spark, d, "_").select(
        F.lit(-1).cast("long").alias("query_id"), "embedding"), "query_id")
    docs = model.table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    closest = search.vector_search(docs, seed, 100).select(F.col("base_id").alias("id"), "rank")
    return search.hybrid(kw, closest, 50)


def edges(spark, d):
    return catalog.graph_tables(files_with_entities(spark, d))["edges"]


EDGES_SQL = f"""WITH {FILES_SQL}, edges AS (
  SELECT 'File:' || file_id AS src, 'Tag:' || lang AS dst, 'TAGGED' AS rel FROM files
  UNION SELECT 'File:' || file_id, 'Tag:' || source, 'TAGGED' FROM files
  UNION SELECT 'File:' || file_id, 'Category:' || category, 'BELONGS_TO' FROM files
  UNION SELECT 'File:' || file_id, 'Entity:organization:' || source, 'MENTIONS' FROM files)"""


@query("j14_cotagged", EDGES_SQL + """ SELECT a.dst AS tag_a, b.dst AS tag_b, count(*) AS shared
FROM edges a JOIN edges b ON a.src = b.src AND a.dst < b.dst AND a.rel = 'TAGGED' AND b.rel = 'TAGGED'
GROUP BY 1, 2 HAVING count(*) >= 2""")
def j14(spark, d):
    return graph.cotagged(edges(spark, d), 2)


@query("j14_neighbours", EDGES_SQL + """ SELECT src AS node_id, dst AS neighbour, rel FROM edges
  WHERE src LIKE 'Tag:%' OR src LIKE 'Category:%'
  UNION SELECT dst, src, rel FROM edges WHERE dst LIKE 'Tag:%' OR dst LIKE 'Category:%'""")
def j14b(spark, d):
    e = edges(spark, d)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    seeds = nodes.filter("node_id LIKE 'Tag:%' OR node_id LIKE 'Category:%'")
    return graph.neighbours(e, seeds)


@query("j14_degrees", EDGES_SQL + """ SELECT node_id, rel, count(*) AS degree FROM (
  SELECT src AS node_id, rel FROM edges UNION ALL SELECT dst, rel FROM edges) GROUP BY 1, 2""")
def j14c(spark, d):
    return graph.degrees(edges(spark, d))
