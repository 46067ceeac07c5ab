"""P01-P18, T01, T02 on the supplied tables."""

from pyspark.sql import functions as F

from opsloom import model
from opsloom.model import FILES_SQL, QUEUE_SQL, SAMPLES_SQL
from opsloom.operators import select as sel
from opsloom.operators import state
from opsloom.plans.registry import query

START, END = "2024-01-05 00:00:00", "2024-01-25 12:00:00"


@query("p01_filter_samples", f"""WITH {SAMPLES_SQL}
SELECT sample_id, name, value, us FROM samples
WHERE collector = 'pipeline' AND ts >= '{START}' AND ts <= '{END}'""")
def p01(spark, d):
    return sel.filter_samples(model.samples(spark, d), start=START, end=END,
                              collector="pipeline").select("sample_id", "name", "value", "us")


@query("p02_name_prefix", f"""WITH {SAMPLES_SQL}
SELECT sample_id, name, value FROM samples WHERE name LIKE 'pur%' OR name LIKE 'si%'""")
def p02(spark, d):
    return sel.by_prefix(model.samples(spark, d), "pur", "si").select("sample_id", "name", "value")


@query("p03_with_label", f"""WITH {SAMPLES_SQL}
SELECT k, count(*) AS n, round(sum(value), 4) AS total FROM samples WHERE k IS NOT NULL GROUP BY k""")
def p03(spark, d):
    return (sel.with_label(model.samples(spark, d), "k", "user_id").groupBy("k")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")))


@query("p04_match_labels", f"""WITH {SAMPLES_SQL}
SELECT sample_id, name, value FROM samples
WHERE regexp_full_match(k, '[1-4]\\d') AND user_id = 7""")
def p04(spark, d):
    return sel.match_labels(model.samples(spark, d), eq={"user_id": "7"},
                            regex={"k": r"[1-4]\d"}).select("sample_id", "name", "value")


@query("p05_history_range", f"""SELECT event_id, event_type, value FROM events
WHERE event_type = 'error' AND ts BETWEEN '{START}' AND '{END}'""")
def p05(spark, d):
    history = model.table(spark, d, "events", model.EVENTS).filter("event_type = 'error'")
    return (sel.between(history, START, END).orderBy(F.desc("ts"), F.desc("event_id"))
            .select("event_id", "event_type", "value"))


@query("p06_extract", "SELECT vec_id, label FROM embeddings WHERE label < 5")
def p06(spark, d):
    return sel.extract(model.table(spark, d, "embeddings"), "label < 5", ["vec_id", "label"])


@query("p07_priority_of", """SELECT CASE WHEN lower(o_orderpriority) LIKE '%high%' THEN 'high'
  WHEN lower(o_orderpriority) LIKE '%medium%' THEN 'medium' ELSE 'low' END AS priority,
  count(*) AS n FROM orders GROUP BY 1""")
def p07(spark, d):
    name = F.lower("o_orderpriority")
    return (model.table(spark, d, "orders").groupBy(sel.priority_of(name).alias("priority"))
            .agg(F.count(F.lit(1)).alias("n")))


ROUTE_SQL = """CASE WHEN mime_type LIKE 'text/%' OR mime_type LIKE 'image/%' THEN 'embeddings_staging'
  WHEN priority = 'high' THEN 'raw_priority'
  WHEN file_size > 104857600 OR mime_type LIKE 'video/%' THEN 'raw_batch' ELSE 'raw_normal' END"""


@query("p08_route_queue", f"WITH {FILES_SQL} SELECT file_id, {ROUTE_SQL} AS queue FROM files")
def p08(spark, d):
    return model.files(spark, d).select("file_id", sel.route_queue(
        F.col("mime_type"), F.col("priority"), F.col("file_size")).alias("queue"))


@query("p09_route_processor", f"""WITH {FILES_SQL} SELECT file_id,
  CASE WHEN mime_type LIKE 'image/%' THEN 'image' WHEN mime_type LIKE 'video/%' THEN 'video'
       ELSE 'text' END AS by_mime,
  CASE WHEN extension IN ('pdf','txt') THEN 'text' WHEN extension = 'jpg' THEN 'image'
       WHEN extension = 'mp4' THEN 'video' END AS by_extension FROM files""")
def p09(spark, d):
    return model.files(spark, d).select(
        "file_id", sel.processor_by_mime(F.col("mime_type")).alias("by_mime"),
        sel.processor_by_extension(F.col("extension")).alias("by_extension"))


@query("p10_embedding_model", f"""WITH {FILES_SQL} SELECT CASE WHEN mime_type LIKE 'image/%'
  THEN 'clip-vit-base-patch32' ELSE 'text-embedding-ada-002' END AS model, count(*) AS n
  FROM files GROUP BY 1""")
def p10(spark, d):
    return (model.files(spark, d).groupBy(sel.embedding_model(F.col("mime_type")).alias("model"))
            .agg(F.count(F.lit(1)).alias("n")))


LOG_SQL = """access_log AS (SELECT event_id, ts, 'client_' || user_id AS client,
  ['/v2/models/m' || (user_id % 10), '/v1/models/n' || (user_id % 10) || ':predict',
   '/predictions/p', '/api/docs', '/health'][CAST(json_extract(props, '$.k') AS INT) % 5 + 1]
  AS path FROM events)"""


def access_log(spark, d):
    """Events as gateway requests; the path depends on user and label."""
    e = model.table(spark, d, "events", model.EVENTS)
    user = F.pmod("user_id", F.lit(10)).cast("string")
    k = F.get_json_object("props", "$.k").cast("int")
    paths = F.array(F.concat(F.lit("/v2/models/m"), user),
                    F.concat(F.lit("/v1/models/n"), user, F.lit(":predict")),
                    F.lit("/predictions/p"), F.lit("/api/docs"), F.lit("/health"))
    return e.select("event_id", "ts",
                    F.concat(F.lit("client_"), F.col("user_id").cast("string")).alias("client"),
                    F.element_at(paths, F.pmod(k, F.lit(5)) + 1).alias("path"))


@query("p11_route_requests", f"""WITH {LOG_SQL}, routed AS (SELECT *,
  CASE WHEN path LIKE '/api/docs%' THEN 'api-docs-service' WHEN path LIKE '/v2%' THEN 'triton-service'
       WHEN path LIKE '/v1/models%' THEN 'tensorflow-service'
       WHEN path LIKE '/predictions%' THEN 'torchserve-service' END AS service,
  CASE WHEN path LIKE '/api/docs%' THEN substr(path, 10) WHEN path LIKE '/v2%' THEN substr(path, 4)
       WHEN path LIKE '/v1/models%' THEN substr(path, 4) ELSE path END AS rest FROM access_log)
SELECT service, CASE WHEN rest LIKE '/%' THEN rest ELSE '/' || rest END AS upstream_path,
  count(*) AS n FROM routed GROUP BY 1, 2""")
def p11(spark, d):
    return (sel.route_requests(access_log(spark, d)).groupBy("service", "upstream_path")
            .agg(F.count(F.lit(1)).alias("n")))


@query("p12_bands", """SELECT event_id, CASE WHEN value >= 150 THEN 'red' WHEN value >= 80 THEN 'yellow'
  ELSE 'green' END AS colour,
  CASE WHEN event_type = 'error' THEN 'Down' ELSE 'Up' END AS state FROM events""")
def p12(spark, d):
    e = model.table(spark, d, "events", model.EVENTS)
    up = F.when(F.col("event_type") == "error", 0).otherwise(1)
    return e.select("event_id",
                    sel.band(F.col("value"), [(None, "green"), (80, "yellow"), (150, "red")])
                    .alias("colour"),
                    sel.map_value(up, {0: "Down", 1: "Up"}).alias("state"))


@query("p13_relabel", """SELECT 'app-' || lower(event_type) AS app, user_id AS pod, count(*) AS n
FROM events WHERE event_type NOT IN ('error') AND regexp_full_match(json_extract_string(props,'$.k'), '\\d\\d')
GROUP BY 1, 2""")
def p13(spark, d):
    s = model.samples(spark, d)
    raw = s.withColumn("labels", F.map_concat(
        F.transform_keys("labels", lambda k, _: F.concat(F.lit("__meta_pod_label_"), k)),
        F.create_map(F.lit("__name"), F.col("name"))))
    rules = [sel.Relabel("keep", r"\d\d", ("__meta_pod_label_k",)),
             sel.Relabel("drop", "error", ("__name",)),
             sel.Relabel("labelmap", "__meta_pod_label_(.+)"),
             sel.Relabel("replace", "(.+)", ("__name",), "app", "app-$1")]
    out = sel.relabel(raw, rules)
    return (out.groupBy(F.col("labels")["app"].alias("app"),
                        F.col("labels")["user_id"].cast("long").alias("pod"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("p14_reject_old", """SELECT event_id, value FROM events
WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 168 HOURS""")
def p14(spark, d):
    return (sel.reject_old(model.table(spark, d, "events", model.EVENTS), "2024-01-30 00:00:00")
            .select("event_id", "value"))


@query("p15_flatten_report", """WITH r AS (SELECT event_type AS name, count(*) AS n,
  max(value) AS hi, min(value) AS lo FROM events GROUP BY 1)
SELECT name, 'usage_max' AS path_key, CAST(CAST(round(hi * 100) AS BIGINT) AS VARCHAR) AS value FROM r
UNION ALL SELECT name, 'usage_min', CAST(CAST(round(lo * 100) AS BIGINT) AS VARCHAR) FROM r
UNION ALL SELECT name, 'n', CAST(n AS VARCHAR) FROM r""")
def p15(spark, d):
    cents = lambda c: F.round(c * 100).cast("long")
    report = (model.samples(spark, d).groupBy("name")
              .agg(F.max("value").alias("hi"), F.min("value").alias("lo"),
                   F.count(F.lit(1)).alias("n"))
              .select("name", "n", F.struct(cents(F.col("hi")).alias("max"),
                                            cents(F.col("lo")).alias("min")).alias("usage")))
    return sel.flatten_report(report, ["name"])


@query("p16_pct", f"""WITH {SAMPLES_SQL} SELECT user_id,
  round(CASE WHEN count(*) FILTER (name <> 'view') > 0 THEN 100.0 * count(*) FILTER (name = 'error')
    / count(*) FILTER (name <> 'view') ELSE 0 END, 6) AS error_pct FROM samples GROUP BY 1""")
def p16(spark, d):
    s = model.samples(spark, d)
    return s.groupBy("user_id").agg(F.round(sel.pct(
        F.count_if(F.col("name") == "error"), F.count_if(F.col("name") != "view")), 6)
        .alias("error_pct"))


@query("p17_storable", f"""WITH {FILES_SQL} SELECT file_id, file_name, md5_hash,
  strftime(to_timestamp(created_s)::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') AS created_at FROM files""")
def p17(spark, d):
    f = model.files(spark, d).select("file_id", "file_name", "md5_hash", "created_at",
                                     F.array(F.lit(0.0)).alias("embeddings"))
    return sel.storable(f)


@query("p18_select_logs", """SELECT event_id, json_extract_string(props, '$.k') AS line FROM events
WHERE event_type = 'error'""")
def p18(spark, d):
    s = model.samples(spark, d)
    log = s.select("sample_id", F.col("labels")["k"].alias("line"),
                   F.create_map(F.lit("container"), F.col("name")).alias("labels"))
    return sel.match_labels(log, eq={"container": "error"}).select(
        F.col("sample_id").alias("event_id"), "line")


@query("t01_newest", """SELECT event_id, event_type, value FROM events
ORDER BY ts DESC, event_id DESC LIMIT 100""")
def t01(spark, d):
    e = model.table(spark, d, "events", model.EVENTS)
    return state.newest(e, 100, ["ts", "event_id"]).select("event_id", "event_type", "value")


@query("t02_next_items", f"""WITH {QUEUE_SQL} SELECT id, priority FROM items WHERE status = 'pending'
ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, created_at, id LIMIT 50""")
def t02(spark, d):
    return state.next_items(model.queue_items(spark, d), 50).select("id", "priority")


@query("t02_next_per_worker", f"""WITH {QUEUE_SQL} SELECT processor, id FROM (
  SELECT processor, id, row_number() OVER (PARTITION BY processor ORDER BY
    CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, created_at, id) AS rn
  FROM items WHERE status = 'pending') WHERE rn <= 10""")
def t02b(spark, d):
    return state.next_items(model.queue_items(spark, d), 10, per=["processor"]).select(
        "processor", "id")
