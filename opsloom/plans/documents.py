"""D01-D10, D13-D15, D25, D26 on the supplied tables."""

from pyspark.sql import functions as F

from opsloom import model
from opsloom.functions import parse, text
from opsloom.model import FILES_SQL
from opsloom.operators import documents as docs
from opsloom.plans.registry import query
from opsloom.plans.selection import ROUTE_SQL

WORDS_SQL = "list_filter(string_split_regex(lower(text), '[^\\p{L}]+'), lambda w: w <> '')"


def page_files(spark, d):
    """Pages as raw files."""
    p = model.table(spark, d, "pages")
    return p.select(F.col("url").alias("path"), F.col("page_id").alias("file_id"),
                    F.octet_length("html").cast("long").alias("length"),
                    F.timestamp_seconds("page_id").alias("modificationTime"),
                    F.encode("html", "UTF-8").alias("content"))


@query("d01_file_metadata", """SELECT url AS path, regexp_extract(url, '([^/]*)$', 1) AS file_name,
  lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '\\.([A-Za-z0-9]+)$', 1)) AS extension,
  strlen(html) AS file_size, CASE WHEN lower(html) LIKE '<!doctype html%' OR lower(html) LIKE '<html%'
  THEN 'text/html' ELSE 'text/plain' END AS mime_type, md5(html) AS md5_hash FROM pages""")
def d01(spark, d):
    return docs.file_metadata(page_files(spark, d)).drop("modified_at")


@query("d02_extract_text", r"""SELECT page_id AS file_id, trim(regexp_replace(replace(replace(replace(
  replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
  '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''),
  '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""")
def d02(spark, d):
    p = model.table(spark, d, "pages").select(
        F.col("page_id").alias("file_id"), F.col("html").alias("content"),
        F.lit("text/html").alias("mime_type"))
    return docs.extract_text(p).select("file_id", "text")


@query("d03_route", f"""WITH {FILES_SQL}, r AS (SELECT *, {ROUTE_SQL} AS queue,
  CASE WHEN mime_type LIKE 'image/%' THEN 'image' WHEN mime_type LIKE 'video/%' THEN 'video'
  ELSE 'text' END AS processor FROM files)
SELECT queue, processor, CASE WHEN queue = 'embeddings_staging' THEN 'embedding' ELSE 'storage' END
  AS next_stage, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM r GROUP BY 1, 2, 3""")
def d03(spark, d):
    return docs.route(model.files(spark, d))


@query("d04_chunk", """WITH c AS (SELECT doc_id AS file_id, text,
  CAST(ceil(length(text) / 8000.0) AS INT) AS chunks FROM documents WHERE length(text) > 0),
p AS (SELECT *, unnest(range(chunks)) AS pos FROM c)
SELECT file_id, pos, chunks, md5(substring(text, pos * 8000 + 1, 8000)) AS chunk_md5 FROM p""")
def d04(spark, d):
    return docs.chunk(model.files(spark, d)).select("file_id", "pos", "chunks",
                                                    F.md5("chunk").alias("chunk_md5"))


EMBED_SQL = f"""WITH c AS (SELECT DISTINCT md5(text) AS md5_hash, text, CAST(ceil(length(text) / 8000.0) AS INT)
  AS n FROM documents), p AS (SELECT md5_hash, pos, substring(text, pos * 8000 + 1, 8000) AS text
  FROM (SELECT *, unnest(range(n)) AS pos FROM c)),
w AS (SELECT md5_hash, pos, unnest({WORDS_SQL}) AS w FROM p),
b AS (SELECT md5_hash, CAST(concat('0x', substring(md5(w), 1, 8)) AS BIGINT) % 64 AS cell,
  count(*) AS n FROM w GROUP BY 1, 2),
norm AS (SELECT md5_hash, sqrt(sum(n * n)) AS l FROM b GROUP BY 1)
SELECT md5_hash, cell, round(n / l, 6) AS x FROM b JOIN norm USING (md5_hash)"""


@query("d05_embed", EMBED_SQL)
def d05(spark, d):
    f = model.files(spark, d).select(F.lit("hashed").alias("model"), "md5_hash", "text")
    out = docs.embed(f)
    return (out.select("md5_hash", F.posexplode("embedding").alias("cell", "x"))
            .filter("x > 0").select("md5_hash", "cell", F.round("x", 6).alias("x")))


@query("d05_embed_misses", f"""WITH {FILES_SQL} SELECT md5_hash, bool_or(priority = 'high') AS cached
FROM files GROUP BY 1""")
def d05b(spark, d):
    f = model.files(spark, d).withColumn("model", F.lit("hashed"))
    cache = f.filter("priority = 'high'").select(
        "model", "md5_hash", F.array(F.lit(-1.0)).alias("value"),
        F.lit("2024-06-01 00:00:00").cast("timestamp").alias("written_at"))
    out = docs.embed(f.select("model", "md5_hash", "text"), cache, "2024-06-01 00:30:00")
    return out.select("md5_hash", F.coalesce(F.element_at("embedding", 1) == -1.0, F.lit(False))
                      .alias("cached"))


PROMPTS_SQL = " UNION ALL ".join(
    f"SELECT doc_id AS file_id, part, '{t}' AS task, '{h}' || substr(text, part * {docs.CHUNK} + 1, {docs.CHUNK}) "
    f"AS prompt FROM (SELECT *, unnest(range(CAST(ceil(length(text) / {docs.CHUNK}) AS BIGINT))) AS part "
    "FROM documents)" for t, (h, _) in docs.PROMPTS.items())


@query("d06_prompts", f"""WITH p AS ({PROMPTS_SQL})
SELECT file_id, part, task, length(prompt) AS size, task || ':' || md5(prompt) AS cache_key FROM p""")
def d06(spark, d):
    return docs.prompts(model.files(spark, d)).select(
        "file_id", "part", "task", F.length("prompt").alias("size"), "cache_key")


def responses(spark, d):
    """Conversation turns as answers to four tasks, some of them malformed."""
    c = model.table(spark, d, "conversations")
    turn = F.col("turn").cast("string")
    graded = F.when(F.col("conv_id") % 3 == 0, F.col("role")).when(
        F.col("conv_id") % 3 == 1, F.concat("role", F.lit(" : 0."), turn)).otherwise(
        F.concat("role", F.lit(":x"), turn))
    found = F.when(F.col("conv_id") % 2 == 0, F.concat(
        F.lit('Found: [{"name":"n'), turn, F.lit('","type":"person"}, {"name":"o","type":"org"}] ok'))
        ).otherwise(F.lit("[{broken"))
    cells = [F.struct(F.lit(t).alias("task"), v.alias("response")) for t, v in (
        ("title", F.col("text")), ("tags", F.col("text")), ("category", graded), ("entities", found))]
    return c.select("conv_id", "turn", F.inline(F.array(*cells)))


@query("d07_parse_responses", """SELECT conv_id, turn, 'title' AS task, trim(text, ' ') AS value, NULL AS tags,
  NULL AS category, NULL AS confidence, NULL AS entities FROM conversations
UNION ALL SELECT conv_id, turn, 'tags', NULL, array_to_string(list_filter(list_transform(
  string_split(text, ','), lambda t: trim(t, ' ')), lambda t: t <> ''), '|'), NULL, NULL, NULL FROM conversations
UNION ALL SELECT conv_id, turn, 'category', NULL, NULL, CASE WHEN conv_id % 3 = 1 THEN role END,
  CASE WHEN conv_id % 3 = 1 THEN CAST('0.' || turn AS DOUBLE) ELSE 0.0 END, NULL FROM conversations
UNION ALL SELECT conv_id, turn, 'entities', NULL, NULL, NULL, NULL,
  CASE WHEN conv_id % 2 = 0 THEN 'n' || turn || '/person,o/org' ELSE '' END FROM conversations""")
def d07(spark, d):
    out = docs.parse_responses(responses(spark, d))
    names = F.transform("entities", lambda e: F.concat_ws("/", e["name"], e["type"]))
    return out.select("conv_id", "turn", "task", "value", F.array_join("tags", "|").alias("tags"),
                      "category", "confidence", F.array_join(names, ",").alias("entities"))


@query("d08_parse_dewey", r"""SELECT doc_id AS file_id, CASE WHEN regexp_matches(text, '\d{3}')
  THEN regexp_extract(text, '(\d{3}(?:\.\d+)?)', 1) ELSE '000.00' END AS dewey FROM documents""")
def d08(spark, d):
    return model.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"),
                                                     parse.dewey(F.col("text")).alias("dewey"))


@query("d09_tags", f"""WITH t AS (SELECT doc_id AS file_id, unnest(list_filter({WORDS_SQL},
  lambda w: length(w) >= 3)) AS term FROM documents),
tf AS (SELECT file_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT file_id, term, round(tf * ln((SELECT count(*) + 1.0 FROM documents) / (df + 1)), 9) AS score
  FROM tf JOIN df USING (term)),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, term) AS rank FROM s)
SELECT file_id, term, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def d09(spark, d):
    return docs.tags(model.files(spark, d)).withColumn("score", F.round("score", 6))


# Keyword lists for the category demo; they use words that occur in all languages of the tables.
LEXICON = {"finance": ["for", "par", "por"], "legal": ["by", "zu", "del"],
           "medical": ["was", "une", "una"], "personal": ["with", "mit", "con"],
           "technical": ["from", "dans", "nicht"]}


def lexicon_sql(lists: dict, extra: str = "") -> str:
    cells = ", ".join(
        f"{{'hits': len(list_filter(w, lambda x: x IN ({', '.join(repr(t) for t in terms)}))), "
        f"'o': {-i}, 'name': '{name}'}}" for i, (name, terms) in enumerate(sorted(lists.items())))
    return f"""WITH t AS (SELECT doc_id AS file_id, {WORDS_SQL} AS w {extra} FROM documents),
c AS (SELECT * EXCLUDE (w), unnest([{cells}]) AS c FROM t),
g AS (SELECT file_id, max(c.hits) AS hits, arg_max(c.name, c.hits * 1000 + c.o) AS name,
  sum(c.hits) AS total FROM c GROUP BY 1)"""


@query("d10_categorise", lexicon_sql(LEXICON) + """ SELECT file_id, CASE WHEN hits > 0 THEN name END
  AS category, round(CASE WHEN total > 0 THEN hits / total ELSE 0 END, 6) AS confidence FROM g""")
def d10(spark, d):
    return docs.categorise(model.files(spark, d), LEXICON).withColumn(
        "confidence", F.round("confidence", 6))


@query("d13_detect_language", lexicon_sql(docs.STOP_WORDS) + """ SELECT lang, CASE WHEN hits > 0
  THEN name END AS language, count(*) AS n FROM g JOIN documents ON doc_id = file_id GROUP BY 1, 2""")
def d13(spark, d):
    f = model.files(spark, d)
    return (docs.detect_language(f).join(f.select("file_id", "lang"), "file_id")
            .groupBy("lang", "language").agg(F.count(F.lit(1)).alias("n")))


TOXIC = ["trash", "clown", "scum", "idiot", "worthless", "moron", "pathetic", "loser", "stupid",
         "disgusting"]
POSITIVE, NEGATIVE = ["and", "et", "und", "y"], ["not", "pas", "nicht", "no"]


def in_sql(terms):
    return f"len(list_filter(w, lambda x: x IN ({', '.join(repr(t) for t in terms)})))"


@query("d14_moderate", f"""WITH t AS (SELECT doc_id AS file_id, {WORDS_SQL} AS w FROM documents),
h AS (SELECT file_id, {in_sql(TOXIC)} AS toxic_hits, {in_sql(POSITIVE)} AS p, {in_sql(NEGATIVE)} AS n
  FROM t) SELECT file_id, toxic_hits, toxic_hits > 0 AS flagged,
  round(CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0 END, 6) AS sentiment FROM h""")
def d14(spark, d):
    return docs.moderate(model.files(spark, d), TOXIC, POSITIVE, NEGATIVE).withColumn(
        "sentiment", F.round("sentiment", 6))


@query("d14_moderation_check", f"""WITH t AS (SELECT doc_id, toxic, {WORDS_SQL} AS w FROM documents
  JOIN labels USING (doc_id)) SELECT toxic, {in_sql(TOXIC)} > 0 AS flagged, count(*) AS n
FROM t GROUP BY 1, 2""")
def d14b(spark, d):
    flagged = docs.moderate(model.files(spark, d), TOXIC, POSITIVE, NEGATIVE)
    labels = model.table(spark, d, "labels").select(F.col("doc_id").alias("file_id"), "toxic")
    return flagged.join(labels, "file_id").groupBy("toxic", "flagged").agg(
        F.count(F.lit(1)).alias("n"))


@query("d15_extract_fields", rf"""SELECT doc_id AS file_id,
  len(regexp_extract_all(text, '{docs.DATE_PATTERN}', 1)) AS dates,
  array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{docs.MAIL_PATTERN}', 1))), ',')
  AS correspondents FROM documents""")
def d15(spark, d):
    out = docs.extract_fields(model.files(spark, d))
    return out.select("file_id", F.size("dates").alias("dates"),
                      F.array_join(F.array_sort("correspondents"), ",").alias("correspondents"))


@query("d15_reassemble", """SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS text_md5
FROM conversations GROUP BY 1""")
def d15b(spark, d):
    c = model.table(spark, d, "conversations")
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content"))
                                               .alias("delta"))).alias("choices")))
    lines = c.select("conv_id", "turn", F.concat(F.lit("data: "), body).alias("line"))
    ends = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).withColumn(
        "line", F.lit("data: [DONE]"))
    return docs.reassemble(lines.unionByName(ends), ["conv_id"], "turn").select(
        "conv_id", F.md5("text").alias("text_md5"))


@query("d25_run_documents", f"""WITH {FILES_SQL}, l AS ({lexicon_sql(docs.STOP_WORDS)}
  SELECT file_id, CASE WHEN hits > 0 THEN name END AS language FROM g),
c AS ({lexicon_sql(LEXICON)} SELECT file_id, CASE WHEN hits > 0 THEN name ELSE '' END AS category FROM g)
SELECT f.file_id, {ROUTE_SQL} AS queue, l.language, c.category AS categories,
  CASE WHEN regexp_matches(text, '\\d{{3}}') THEN regexp_extract(text, '(\\d{{3}}(?:\\.\\d+)?)', 1)
  ELSE '000.00' END AS dewey_decimal, CAST(ceil(length(text) / 8000.0) AS BIGINT) AS chunk_count
FROM files f JOIN l USING (file_id) JOIN c USING (file_id)""")
def d25(spark, d):
    out = docs.run_documents(model.files(spark, d), LEXICON)
    return out["enriched"].select("file_id", "queue", "language",
                                  F.array_join("categories", ",").alias("categories"),
                                  "dewey_decimal", "chunk_count")


def broken_events(spark, d):
    e = model.table(spark, d, "events", model.EVENTS)
    raw = F.when(F.col("event_type") == "error", F.left("props", F.lit(5))).otherwise(F.col("props"))
    return e.select("event_id", "value", raw.alias("raw"),
                    F.from_json(raw, "k int, _corrupt_record string",
                                {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("p"))


@query("d26_errors", """SELECT event_id, 'bad json' AS error FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, 'tiny value' FROM events WHERE value < 1""")
def d26(spark, d):
    _, errors = docs.with_errors(broken_events(spark, d), "event_id", {
        "bad json": F.col("p._corrupt_record").isNotNull(), "tiny value": F.col("value") < 1})
    return errors


@query("d26_good_rows", """SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events
WHERE event_type <> 'error' AND value >= 1""")
def d26b(spark, d):
    good, _ = docs.with_errors(broken_events(spark, d), "event_id", {
        "bad json": F.col("p._corrupt_record").isNotNull(), "tiny value": F.col("value") < 1})
    return good.select("event_id", "p.k")
