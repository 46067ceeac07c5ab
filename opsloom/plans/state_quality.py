"""U02-U07, Q01-Q05, J01, J02, J05-J09, J15, D24, S09-S13, S19 on the supplied tables."""

from pyspark.sql import functions as F

from opsloom import model
from opsloom.model import FILES_SQL, QUEUE_SQL, SAMPLES_SQL
from opsloom.operators import catalog, joins, quality, state
from opsloom.plans.registry import query


@query("u02_dedup_exact", f"""WITH {FILES_SQL} SELECT min(file_id) AS file_id, md5_hash FROM files
GROUP BY md5_hash""")
def u02(spark, d):
    return state.dedup_exact(model.files(spark, d).select("file_id", "md5_hash")).select(
        "file_id", "md5_hash")


@query("u02_duplicate_counts", f"""WITH {FILES_SQL} SELECT md5_hash, count(*) AS copies FROM files
GROUP BY 1 HAVING count(*) > 1""")
def u02b(spark, d):
    return state.duplicate_counts(model.files(spark, d).select("file_id", "md5_hash"))


@query("u04_missing", """SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem""")
def u04(spark, d):
    present = model.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return state.missing(model.table(spark, d, "orders"), present, ["o_orderkey"])


def alert_log(spark, d):
    """Orders as a change log of alert states keyed by customer."""
    return model.table(spark, d, "orders").select(
        F.col("o_custkey").alias("alert_id"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("seq"),
        F.col("o_orderpriority").alias("severity"), (F.col("o_orderstatus") == "P").alias("deleted"),
        F.col("o_totalprice").alias("value"))


@query("u05_upsert", """WITH c AS (SELECT o_custkey AS alert_id, o_orderdate AS t, o_orderkey AS seq,
  o_totalprice AS value, o_orderstatus = 'P' AS deleted FROM orders),
g AS (SELECT *, max(CASE WHEN deleted THEN epoch_us(t)::HUGEINT * 1000000000 + seq END) OVER (
  PARTITION BY alert_id) AS gone FROM c),
a AS (SELECT * FROM g WHERE gone IS NULL OR epoch_us(t)::HUGEINT * 1000000000 + seq > gone)
SELECT alert_id, epoch_us(min(t)) AS created_us, epoch_us(max(t)) AS updated_us,
  arg_max(value, epoch_us(t)::HUGEINT * 1000000000 + seq) AS value FROM a GROUP BY 1""")
def u05(spark, d):
    log = alert_log(spark, d)
    out = state.upsert(log.filter("severity = '1-URGENT'"), log.filter("severity <> '1-URGENT'"),
                       "alert_id")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.select("alert_id", us("created_at").alias("created_us"),
                      us("updated_at").alias("updated_us"), "value")


@query("u06_retention", f"""WITH {SAMPLES_SQL} SELECT name,
  count(*) FILTER (ts < TIMESTAMP '2024-02-09 12:00:00' - INTERVAL 30 DAYS) AS dropped,
  count(*) FILTER (ts >= TIMESTAMP '2024-02-09 12:00:00' - INTERVAL 30 DAYS) AS kept
FROM samples GROUP BY 1""")
def u06(spark, d):
    return state.retention_count(model.samples(spark, d), 30, "2024-02-09 12:00:00", by=["name"])


@query("u06_retained_rows", """SELECT event_id FROM events
WHERE ts >= TIMESTAMP '2024-02-09 12:00:00' - INTERVAL 30 DAYS""")
def u06b(spark, d):
    return state.retain(model.table(spark, d, "events", model.EVENTS), 30,
                        "2024-02-09 12:00:00").select("event_id")


@query("s12_cache_rows", f"""WITH {FILES_SQL}, j AS (SELECT *, '{{"id":' || file_id ||
  ',"dewey_decimal":"' || dewey_decimal || '","title":"' || file_name || '","tags":["' || lang ||
  '","' || source || '"],"categories":["' || category || '"],"storage":{{"bucket":"raw-data","object":"'
  || dewey_decimal || '/' || file_id || '/' || file_name || '"}}}}' AS value FROM files)
SELECT 'file:' || file_id AS key, value, 3600 AS ttl_s FROM j
UNION ALL SELECT 'dewey:' || dewey_decimal, arg_max(value, file_id), 3600 FROM j GROUP BY dewey_decimal""")
def s12(spark, d):
    return catalog.cache_rows(model.files(spark, d)).select("key", "value", "ttl_s")


@query("u07_live_cache", f"""WITH {FILES_SQL} SELECT 'file:' || file_id AS key FROM files
WHERE created_s + 3600 > epoch(TIMESTAMP '2024-01-01 02:00:00')""")
def u07(spark, d):
    return state.live_cache(catalog.cache_rows(model.files(spark, d)), "2024-01-01 02:00:00",
                            "file:%").select("key")


@query("q01_check_required", """SELECT event_id, 'kind' AS field, 'missing' AS problem FROM events
WHERE event_type = 'error' UNION ALL SELECT event_id, 'props', 'type' FROM events""")
def q01(spark, d):
    e = model.table(spark, d, "events", model.EVENTS).withColumn(
        "kind", F.when(F.col("event_type") != "error", F.col("event_type")))
    return quality.check_required(e, "event_id", {"kind": "string", "value": "double",
                                                  "props": "int"})


@query("q02_check_dewey", f"""WITH {FILES_SQL}, d AS (SELECT file_id, CASE WHEN file_size > 2000
  THEN dewey_decimal || '3' ELSE dewey_decimal END AS dewey_decimal FROM files)
SELECT file_id, dewey_decimal FROM d WHERE NOT regexp_full_match(dewey_decimal, '\\d{{3}}(\\.\\d{{1,2}})?')""")
def q02(spark, d):
    f = model.files(spark, d)
    long = F.when(F.col("file_size") > 2000, F.concat("dewey_decimal", F.lit("3"))).otherwise(
        F.col("dewey_decimal"))
    return quality.check_dewey(f.select("file_id", long.alias("dewey_decimal")), "file_id")


@query("q03_check_unique", """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1""")
def q03(spark, d):
    return quality.check_unique(model.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("q04_check_fk", """SELECT doc_id, n_chars FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q04(spark, d):
    return quality.check_fk(model.table(spark, d, "documents").select("doc_id", "n_chars"),
                            model.table(spark, d, "labels"), "doc_id", "doc_id")


@query("q05_check_defs", f"""WITH {SAMPLES_SQL}, defs AS (SELECT DISTINCT collector,
  name || '_' || (user_id % 50) AS name, ['gauge','counter','histogram','summary'][user_id % 4 + 1] AS type,
  user_id % 20 AS interval_s FROM samples)
SELECT collector, name, 'type' AS problem FROM defs WHERE type NOT IN ('gauge','counter','histogram')
UNION ALL SELECT collector, name, 'interval' FROM defs WHERE interval_s < 10
UNION ALL SELECT NULL, name, 'duplicate' FROM defs GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'network', NULL, 'section'""")
def q05(spark, d):
    types = F.array(*[F.lit(t) for t in ("gauge", "counter", "histogram", "summary")])
    defs = model.samples(spark, d).select(
        "collector", F.concat("name", F.lit("_"), F.pmod("user_id", F.lit(50)).cast("string"))
        .alias("name"), F.element_at(types, (F.pmod("user_id", F.lit(4)) + 1).cast("int"))
        .alias("type"), F.pmod("user_id", F.lit(20)).alias("interval_s")).distinct()
    return quality.check_defs(defs, ["queue", "system", "pipeline", "network"])


@query("j01_join_sidecars", f"""WITH {FILES_SQL} SELECT f.file_path, f.file_size, l.quality
FROM files f LEFT JOIN labels l ON l.doc_id = f.file_id""")
def j01(spark, d):
    f = model.files(spark, d).select("file_path", "file_id", "file_size")
    side = model.table(spark, d, "labels").join(f, F.col("doc_id") == F.col("file_id")).select(
        F.col("file_path").alias("path"), "quality")
    return joins.join_sidecars(f, side).select("file_path", "file_size", "quality")


DEWEY_CASE = "CASE CAST(dewey_decimal[1] AS INT) " + " ".join(
    f"WHEN {i} THEN '{c}'" for i, (_, _, c) in enumerate(joins.DEWEY_RANGES)) + " END"


@query("j02_dewey_category", f"""WITH {FILES_SQL} SELECT file_id, {DEWEY_CASE} AS dewey_category
FROM files""")
def j02(spark, d):
    return joins.dewey_category(model.files(spark, d), joins.dewey_ranges(spark)).select(
        "file_id", "dewey_category")


@query("j05_cache_lookup", f"""WITH {FILES_SQL}, c AS (SELECT DISTINCT md5_hash FROM files
  WHERE 1704067200 + file_size > epoch(TIMESTAMP '2024-01-01 01:00:00') - 3600 + 900)
SELECT file_id, md5_hash IN (SELECT md5_hash FROM c) AS hit FROM files""")
def j05(spark, d):
    f = model.files(spark, d).withColumn("model", F.lit("text-embedding-ada-002"))
    cache = f.select("model", "md5_hash",
                     F.timestamp_seconds(F.lit(1704067200) + F.col("file_size")).alias("written_at"),
                     F.lit("[]").alias("value"))
    return joins.cache_lookup(f.select("file_id", "model", "md5_hash"), cache,
                              "2024-01-01 01:15:00").select("file_id", "hit")


@query("j06_insert_absent", """WITH old AS (SELECT doc_id AS k, lang FROM documents
  WHERE lang = 'en'), n AS (SELECT doc_id // 2 AS k, lang, doc_id FROM documents)
SELECT k, lang FROM old UNION ALL SELECT k, arg_min(lang, doc_id) FROM n
WHERE k NOT IN (SELECT k FROM old) GROUP BY k""")
def j06(spark, d):
    doc = model.table(spark, d, "documents")
    old = doc.filter("lang = 'en'").select(F.col("doc_id").alias("k"), "lang")
    new = doc.select(F.expr("doc_id div 2").alias("k"), "lang", "doc_id")
    return joins.insert_absent(new, old, ["k"], "doc_id")


@query("j07_tag_ids", """WITH old AS (SELECT DISTINCT 'old-' || lang AS tag_id, lang AS name,
  'auto' AS category FROM documents), w AS (SELECT lang AS name, 'auto' AS category FROM documents
  UNION SELECT source, 'auto' FROM documents)
SELECT tag_id, name, category FROM old UNION ALL
SELECT md5(name || chr(1) || category), name, category FROM w
WHERE name NOT IN (SELECT name FROM old)""")
def j07(spark, d):
    doc = model.table(spark, d, "documents")
    old = doc.select(F.concat(F.lit("old-"), "lang").alias("tag_id"), F.col("lang").alias("name"),
                     F.lit("auto").alias("category")).distinct()
    names = doc.select(F.explode(F.array("lang", "source")).alias("name"),
                       F.lit("auto").alias("category"))
    return joins.tag_ids(names, old)


@query("j08_processing_times", f"""WITH {QUEUE_SQL} SELECT id AS file_id,
  CASE WHEN done_at IS NOT NULL AND status <> 'pending'
       THEN (epoch_us(done_at) - epoch_us(created_at)) / 1000.0 END AS processing_time_ms,
  CASE WHEN done_at IS NULL OR status = 'pending' THEN 'open' WHEN status = 'done' THEN 'completed'
       ELSE 'error' END AS state FROM items""")
def j08(spark, d):
    return joins.processing_times(queue_points(spark, d))


def queue_points(spark, d):
    items = model.queue_items(spark, d)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    end = F.when(F.col("status") == "done", "completed").when(F.col("status") == "failed", "error")
    started = items.select(F.col("id").alias("file_id"), F.lit("started").alias("status"),
                           us("created_at").alias("us"))
    ended = items.filter(end.isNotNull() & F.col("done_at").isNotNull()).select(
        F.col("id").alias("file_id"), end.alias("status"), us("done_at").alias("us"))
    return started.unionByName(ended)


@query("j09_files_with_tags", f"""WITH {FILES_SQL} SELECT file_id, file_name FROM files
WHERE lang = 'en' OR source IN ('src3', 'src13')""")
def j09(spark, d):
    f = model.files(spark, d)
    cat = catalog.build_catalog(f)
    return joins.files_with_tags(f, cat["file_tags"], cat["tags"], ["en", "src3", "src13"], 0.5).select(
        "file_id", "file_name")


@query("j15_only_new", f"""WITH {FILES_SQL} SELECT file_id FROM files WHERE md5_hash NOT IN (
  SELECT md5_hash FROM files WHERE priority = 'high')""")
def j15(spark, d):
    f = model.files(spark, d)
    return joins.only_new(f, f.filter("priority = 'high'")).select("file_id")


@query("d24_retry_plan", f"""WITH {QUEUE_SQL} SELECT processor, plan, count(*) AS n FROM (
  SELECT *, CASE WHEN coalesce(attempts, 0) < max_attempts THEN 'retry' ELSE 'failed_jobs' END AS plan
  FROM items WHERE status = 'failed') GROUP BY 1, 2""")
def d24(spark, d):
    return (joins.retry_plan(model.queue_items(spark, d)).groupBy("processor", "plan")
            .agg(F.count(F.lit(1)).alias("n")))


@query("s09_catalog_files", f"""WITH {FILES_SQL} SELECT file_id, dewey_decimal, file_name, file_path,
  extension AS file_type, file_size, dewey_decimal || '/' || file_id || '/' || file_name AS object_key
FROM files""")
def s09(spark, d):
    return catalog.build_catalog(model.files(spark, d))["files"]


@query("s09_catalog_file_tags", f"""WITH {FILES_SQL}, t AS (SELECT file_id, lang AS name FROM files
  UNION SELECT file_id, source FROM files)
SELECT file_id, md5(name || chr(1) || 'auto') AS tag_id, 1.0::DOUBLE AS confidence FROM t""")
def s09b(spark, d):
    return catalog.build_catalog(model.files(spark, d))["file_tags"]


@query("s09_catalog_tags", f"""WITH {FILES_SQL}, t AS (SELECT lang AS name FROM files
  UNION SELECT source FROM files)
SELECT md5(name || chr(1) || 'auto') AS tag_id, name, 'auto' AS category FROM t""")
def s09c(spark, d):
    return catalog.build_catalog(model.files(spark, d))["tags"]


@query("s09_catalog_dewey", f"""WITH {FILES_SQL} SELECT dewey_decimal, {DEWEY_CASE} AS category,
  arg_min(file_name, file_id) AS description FROM files GROUP BY 1, 2""")
def s09d(spark, d):
    return catalog.build_catalog(model.files(spark, d))["dewey_catalog"]


@query("s19_vector_locations", f"""WITH {FILES_SQL} SELECT file_id, 'meilisearch' AS vector_store,
  file_id AS vector_id, 'text-embedding-ada-002' AS embedding_model, len(embedding) AS dimensions
FROM files JOIN embeddings ON vec_id = file_id""")
def s19(spark, d):
    vecs = model.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("file_id"), F.lit("text-embedding-ada-002").alias("model"),
        "embedding")
    return catalog.vector_locations(model.files(spark, d), vecs)


@query("s10_search_docs", f"""WITH {FILES_SQL} SELECT file_id AS id, dewey_decimal, file_name,
  file_name AS title, '' AS summary, lang AS language, mime_type, extension,
  strftime(to_timestamp(created_s)::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') AS created_at, file_size,
  lang || ',' || source AS tags, category AS categories FROM files""")
def s10(spark, d):
    out = catalog.search_docs(model.files(spark, d).withColumnRenamed("lang", "language"))
    return out.withColumns({"tags": F.array_join("tags", ","),
                            "categories": F.array_join("categories", ",")})


@query("s11_graph_nodes", f"""WITH {FILES_SQL} SELECT 'File:' || file_id AS node_id, 'File' AS kind,
  CAST(file_id AS VARCHAR) AS key FROM files
UNION SELECT 'Tag:' || lang, 'Tag', lang FROM files UNION SELECT 'Tag:' || source, 'Tag', source FROM files
UNION SELECT 'Category:' || category, 'Category', category FROM files
UNION SELECT 'Entity:organization:' || source, 'Entity', source FROM files""")
def s11(spark, d):
    return catalog.graph_tables(files_with_entities(spark, d))["nodes"].select(
        "node_id", "kind", "key")


@query("s11_graph_edges", f"""WITH {FILES_SQL} SELECT 'File:' || file_id AS src, 'Tag:' || lang AS dst,
  'TAGGED' AS rel FROM files
UNION SELECT 'File:' || file_id, 'Tag:' || source, 'TAGGED' FROM files
UNION SELECT 'File:' || file_id, 'Category:' || category, 'BELONGS_TO' FROM files
UNION SELECT 'File:' || file_id, 'Entity:organization:' || source, 'MENTIONS' FROM files""")
def s11b(spark, d):
    return catalog.graph_tables(files_with_entities(spark, d))["edges"]


def files_with_entities(spark, d):
    return model.files(spark, d).withColumn("entities", F.array(F.struct(
        F.col("source").alias("name"), F.lit("organization").alias("type"))))


@query("s13_lifecycle_points", f"""WITH {FILES_SQL} SELECT file_id, 'started' AS status,
  created_s * 1000000 AS us, file_path AS detail FROM files
UNION ALL SELECT file_id, 'completed', (created_s + file_size) * 1000000,
  CAST(file_size * 1000 AS VARCHAR) FROM files WHERE file_size >= 500
UNION ALL SELECT file_id, 'error', (created_s + file_size) * 1000000, 'too short' FROM files
  WHERE file_size < 500""")
def s13(spark, d):
    f = model.files(spark, d).withColumns({
        "finished_at": F.timestamp_seconds(F.unix_seconds("created_at") + F.col("file_size")),
        "error": F.when(F.col("file_size") < 500, "too short")})
    p = catalog.lifecycle_points(f)
    return p.select(
        F.col("tags")["file_id"].cast("long").alias("file_id"), F.col("tags")["status"].alias("status"),
        F.unix_micros("ts").alias("us"),
        F.coalesce(F.col("fields")["path"], F.col("fields")["processing_time_ms"],
                   F.col("fields")["error"]).alias("detail"))
