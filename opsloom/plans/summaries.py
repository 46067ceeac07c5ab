"""A01-A11, A15-A16, A20, A25-A32, W01, W10 on the supplied tables."""

from pyspark.sql import functions as F

from opsloom import model
from opsloom.model import FILES_SQL, QUEUE_SQL, SAMPLES_SQL
from opsloom.operators import ordered, state
from opsloom.operators import select as sel
from opsloom.operators import summary as sm
from opsloom.plans.registry import query
from opsloom.plans.selection import LOG_SQL, ROUTE_SQL, access_log

TREND_CASE = """CASE WHEN n < 2 OR slope IS NULL OR abs(slope) < 0.1 THEN 'stable'
  WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend"""


def summary_sql(keys: dict, where: str = "TRUE", extra: str = "") -> str:
    by = ", ".join(keys)
    inner = ", ".join(f"{e} AS {k}" if e != k else k for k, e in keys.items())
    part = f"PARTITION BY {', '.join(keys.values())}" if keys else ""
    group = f"GROUP BY {by}" if keys else ""
    lead = f"{by}, " if keys else ""
    return f"""WITH {SAMPLES_SQL}, r AS (SELECT {inner + ', ' if keys else ''}value, us,
  row_number() OVER ({part} ORDER BY us, sample_id) - 1 AS i FROM samples WHERE {where}),
a AS (SELECT {lead}count(*) AS n, arg_max(value, i) AS cur, avg(value) AS av, max(value) AS mx,
  CASE WHEN count(*) > 1 THEN regr_slope(value, i) END AS slope{extra} FROM r {group})
SELECT {lead}n, cur AS current, round(av, 6) AS avg, mx AS max, round(slope, 6) AS slope,
  {TREND_CASE}{', round(total, 4) AS total' if extra else ''} FROM a"""


def shown(df):
    return df.withColumns({"avg": F.round("avg", 6), "slope": F.round("slope", 6)})


@query("a01_metric_summary", f"""WITH {SAMPLES_SQL} SELECT collector, name, min(value) AS min_value,
  max(value) AS max_value, round(avg(value), 6) AS avg_value, arg_max(value, us) AS last_value,
  max(us) AS last_update FROM samples GROUP BY 1, 2""")
def a01(spark, d):
    return sm.metric_summary(model.samples(spark, d)).withColumn(
        "avg_value", F.round("avg_value", 6))


@query("a02_ewma_half", f"""WITH {SAMPLES_SQL}, r AS (SELECT name, value,
  row_number() OVER (PARTITION BY name ORDER BY us DESC) AS r,
  count(*) OVER (PARTITION BY name) AS n FROM samples)
SELECT name, round(sum(value * pow(0.5, CASE WHEN r = n THEN r - 1 ELSE r END)), 6) AS ewma_half
FROM r GROUP BY name""")
def a02(spark, d):
    return sm.ewma_half(model.samples(spark, d)).withColumn("ewma_half", F.round("ewma_half", 6))


@query("a03_health", summary_sql({}, "name = 'error'"))
def a03(spark, d):
    return shown(sm.health(model.samples(spark, d), "error"))


@query("a04_health_by_label", summary_sql({"k": "k"}, "name IN ('view', 'error')"))
def a04(spark, d):
    s = sel.with_label(model.samples(spark, d).filter(F.col("name").isin("view", "error")), "k")
    return shown(sm.series_summary(s, ["k"]))


@query("a05_processing_perf", summary_sql({"name": "name", "window_us": "us - us % 3600000000"},
                                          "name LIKE 'pur%' OR name LIKE 'vi%'"))
def a05(spark, d):
    s = sel.by_prefix(model.samples(spark, d), "pur", "vi")
    return shown(sm.series_summary(s.withColumn("window_us", sm.window_start("us", 3600)),
                                   ["name", "window_us"]))


@query("a06_error_stats", summary_sql({"error_type": "'E' || (k::INT % 7)"}, "name = 'error'",
                                      ", sum(value) AS total"))
def a06(spark, d):
    s = model.samples(spark, d).filter("name = 'error'").withColumn(
        "error_type", F.concat(F.lit("E"), F.pmod(F.col("labels")["k"].cast("int"), F.lit(7))
                               .cast("string")))
    return shown(sm.error_stats(s, ["error_type"])).withColumn("total", F.round("total", 4))


@query("a06_error_stats_untyped", summary_sql({"error_type": "CASE WHEN k::INT % 7 <> 3 THEN 'E' || (k::INT % 7) END"},
                                             "name = 'error'", ", sum(value) AS total"))
def a06b(spark, d):
    """Errors without a type are a type of their own."""
    kind = F.pmod(F.col("labels")["k"].cast("int"), F.lit(7))
    s = model.samples(spark, d).filter("name = 'error'").withColumn(
        "error_type", F.when(kind != 3, F.concat(F.lit("E"), kind.cast("string"))))
    return shown(sm.error_stats(s, ["error_type"])).withColumn("total", F.round("total", 4))


@query("a07_queue_stats", summary_sql(
    {"queue": "name", "priority": "['high','medium','low'][user_id % 3 + 1]",
     "window_us": "us - us % 21600000000"}, "collector = 'queue'"))
def a07(spark, d):
    prio = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")),
                        (F.pmod("user_id", F.lit(3)) + 1).cast("int"))
    s = (model.samples(spark, d).filter("collector = 'queue'")
         .withColumns({"queue": F.col("name"), "priority": prio,
                       "window_us": sm.window_start("us", 21600)}))
    return shown(sm.series_summary(s, ["queue", "priority", "window_us"]))


@query("a08_trend", summary_sql({"name": "name"}))
def a08(spark, d):
    return shown(sm.series_summary(model.samples(spark, d), ["name"]))


@query("a08_trend_as_coded", f"""WITH {SAMPLES_SQL}, r AS (SELECT name, value,
  row_number() OVER (PARTITION BY name ORDER BY us DESC, sample_id DESC) - 1 AS i FROM samples),
a AS (SELECT name, count(*) AS n, arg_max(value, i) AS current, regr_slope(value, i) AS slope
  FROM r GROUP BY 1) SELECT name, current, round(slope, 6) AS slope FROM a""")
def a08b(spark, d):
    return shown(sm.series_summary(model.samples(spark, d), ["name"], as_coded=True)).select(
        "name", "current", "slope")


@query("a09_daily_report", summary_sql({"day_us": "us - us % 86400000000", "section": "collector",
                                        "item": "name"}))
def a09(spark, d):
    s = model.samples(spark, d).withColumns({"day_us": sm.window_start("us", 86400),
                                             "section": F.col("collector"), "item": F.col("name")})
    return shown(sm.series_summary(s, ["day_us", "section", "item"]))


NOW = "2024-01-30 12:00:00"


@query("a10_range_summary", f"""WITH {SAMPLES_SQL} SELECT collector, """ + ", ".join(
    f"count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL {h} HOURS) AS n_{r}, "
    f"round(avg(value) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL {h} HOURS), 6) AS avg_{r}"
    for r, h in sm.RANGES.items()) + f""" FROM samples
WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 168 HOURS AND ts <= TIMESTAMP '{NOW}' GROUP BY 1""")
def a10(spark, d):
    out = sm.range_summary(model.samples(spark, d), NOW)
    return out.withColumns({f"avg_{r}": F.round(f"avg_{r}", 6) for r in sm.RANGES})


@query("a11_queue_wait", f"""WITH {QUEUE_SQL}, w AS (SELECT processor, priority, count(*) AS n,
  avg(epoch_us(TIMESTAMP '2002-01-01') / 1e6 - epoch_us(created_at) / 1e6) AS wait
  FROM items WHERE status = 'pending' GROUP BY 1, 2)
SELECT processor, priority, n AS queue_size, round(wait, 3) AS wait_time,
  round(60 / wait * 1e6, 6) AS rate_e6 FROM w""")
def a11(spark, d):
    return sm.queue_wait(model.queue_items(spark, d), "2002-01-01").select(
        "processor", "priority", "queue_size", F.round("wait_time", 3).alias("wait_time"),
        F.round(F.col("processing_rate") * 1e6, 6).alias("rate_e6"))


STATS_SQL = f"""WITH {SAMPLES_SQL}, o AS (SELECT strftime(ts, '%Y-%m-%d') AS snapshot,
  'p' || (user_id % 8) AS processor, 'E' || (k::INT % 3) AS error_type, name = 'error' AS bad
  FROM samples)"""


def error_snapshots(spark, d):
    """One nested error snapshot per day, built from counts (the maps hold one entry per type)."""
    o = model.samples(spark, d).select(
        F.date_format("ts", "yyyy-MM-dd").alias("snapshot"),
        F.concat(F.lit("p"), F.pmod("user_id", F.lit(8)).cast("string")).alias("processor"),
        F.concat(F.lit("E"), F.pmod(F.col("labels")["k"].cast("int"), F.lit(3)).cast("string"))
        .alias("error_type"), (F.col("name") == "error").alias("bad"))
    cells = o.groupBy("snapshot", "processor", "error_type").agg(
        F.count(F.lit(1)).alias("ops"), F.count_if("bad").alias("errs"))
    entry = F.when(F.col("errs") > 0, F.struct("error_type", "errs"))
    procs = cells.groupBy("snapshot", "processor").agg(
        F.struct(F.sum("ops").alias("operations"), F.sum("errs").alias("errors"),
                 F.map_from_entries(F.collect_list(entry)).alias("error_types")).alias("s"))
    procs = procs.groupBy("snapshot").agg(
        F.map_from_entries(F.collect_list(F.struct("processor", "s"))).alias("processor_errors"))
    types = cells.filter("errs > 0").groupBy("snapshot", "error_type").agg(
        F.sum("errs").alias("errs"))
    types = types.groupBy("snapshot").agg(
        F.map_from_entries(F.collect_list(F.struct("error_type", "errs"))).alias("error_types"))
    totals = cells.groupBy("snapshot").agg(F.sum("ops").alias("total_operations"),
                                           F.sum("errs").alias("total_errors"))
    return totals.join(types, "snapshot", "left").join(procs, "snapshot")


@query("a15_error_metrics", STATS_SQL + """, p AS (
SELECT snapshot, 'pipeline_error_rate' AS metric, NULL AS processor, NULL AS error_type,
  100.0 * count(*) FILTER (bad) / count(*) AS value FROM o GROUP BY 1
UNION ALL SELECT snapshot, 'error_count', NULL, error_type, count(*) FROM o WHERE bad GROUP BY 1, 4
UNION ALL SELECT snapshot, 'processor_error_rate', processor, NULL,
  100.0 * count(*) FILTER (bad) / count(*) FROM o GROUP BY 1, 3
UNION ALL SELECT snapshot, 'processor_error_count', processor, error_type, count(*)
  FROM o WHERE bad GROUP BY 1, 3, 4)
SELECT snapshot, metric, processor, error_type, round(value, 6) AS value FROM p""")
def a15(spark, d):
    return sm.error_metrics(error_snapshots(spark, d)).withColumn("value", F.round("value", 6))


@query("a16_performance", """SELECT p_type AS processor, p_brand AS file_type,
  round(avg(l_quantity), 6) AS avg_time, max(l_quantity) AS max_time, min(l_quantity) AS min_time,
  count(*) AS n, grouping(p_type, p_brand) AS level
FROM lineitem JOIN part ON p_partkey = l_partkey
GROUP BY GROUPING SETS ((), (p_type), (p_type, p_brand))""")
def a16(spark, d):
    rows = (model.table(spark, d, "lineitem").select("l_partkey", "l_quantity")
            .join(model.table(spark, d, "part").select("p_partkey", "p_type", "p_brand"),
                  F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("p_type").alias("processor"), F.col("p_brand").alias("file_type"),
                    "l_quantity"))
    return sm.performance_metrics(rows, "processor", "file_type", "l_quantity").withColumn(
        "avg_time", F.round("avg_time", 6))


@query("a16_performance_snapshot", f"""WITH {FILES_SQL}, o AS (SELECT source AS snapshot, lang AS p,
  extension AS f, CAST(file_size AS DOUBLE) AS v FROM files), a AS (
SELECT snapshot, NULL AS processor, NULL AS file_type, unnest(['avg_processing_time',
  'max_processing_time','min_processing_time','pipeline_cpu_usage','pipeline_memory_usage',
  'pipeline_disk_io']) AS metric, unnest([avg(v), max(v), min(v), count(*)::DOUBLE, 0, 0]) AS value
  FROM o GROUP BY 1
UNION ALL SELECT snapshot, p, NULL, unnest(['processor_avg_time','processor_max_time',
  'processor_min_time']), unnest([avg(v), max(v), min(v)]) FROM o GROUP BY 1, 2
UNION ALL SELECT snapshot, p, f, 'processor_avg_time', avg(v) FROM o GROUP BY 1, 2, 3)
SELECT snapshot, processor, file_type, metric, round(value, 6) AS value FROM a""")
def a16b(spark, d):
    o = model.files(spark, d).select(F.col("source").alias("snapshot"), F.col("lang").alias("p"),
                                     F.col("extension").alias("f"),
                                     F.col("file_size").cast("double").alias("v"))
    cell = o.groupBy("snapshot", "p", "f").agg(F.sum("v").alias("s"), F.count("v").alias("n"),
                                               F.max("v").alias("hi"), F.min("v").alias("lo"))
    mean = F.sum("s") / F.sum("n")
    per_proc = cell.groupBy("snapshot", "p").agg(F.struct(
        mean.alias("average_time"), F.max("hi").alias("max_time"), F.min("lo").alias("min_time"),
        F.map_from_entries(F.collect_list(F.struct(
            "f", F.struct((F.col("s") / F.col("n")).alias("average_time"))))).alias("file_types"))
        .alias("st"))
    per_proc = per_proc.groupBy("snapshot").agg(
        F.map_from_entries(F.collect_list(F.struct("p", "st"))).alias("processors"))
    total = cell.groupBy("snapshot").agg(
        mean.alias("average_processing_time"), F.max("hi").alias("max_processing_time"),
        F.min("lo").alias("min_processing_time"),
        F.struct(F.sum("n").cast("double").alias("cpu_usage"),
                 F.lit(None).cast("double").alias("memory_usage"),
                 F.lit(None).cast("double").alias("disk_io")).alias("resource_utilization"))
    return sm.performance_snapshot_metrics(total.join(per_proc, "snapshot")).withColumn(
        "value", F.round("value", 6))


@query("a20_queue_status", f"""WITH {FILES_SQL} SELECT {ROUTE_SQL} AS queue, count(*) AS files,
  CAST(sum(file_size) AS BIGINT) AS bytes, CAST(sum(file_size) AS BIGINT) AS bytes_with_sidecars
FROM files GROUP BY 1""")
def a20(spark, d):
    return sm.queue_status(model.files(spark, d), sel.route_queue(
        F.col("mime_type"), F.col("priority"), F.col("file_size")))


@query("a25_health_rollup", """SELECT n_name AS service, count(*) AS total,
  count(*) FILTER (s_acctbal > 1000) AS up, CASE WHEN count(*) FILTER (s_acctbal > 1000) = count(*)
  THEN 'PASS' WHEN count(*) FILTER (s_acctbal > 1000) > 0 THEN 'WARN' ELSE 'FAIL' END AS status
FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""")
def a25(spark, d):
    s, n = model.table(spark, d, "supplier"), model.table(spark, d, "nation")
    checks = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("service"), (F.col("s_acctbal") > 1000).alias("up"))
    return sm.health_rollup(checks, ["service"])


@query("a26_collector_status", f"""WITH {SAMPLES_SQL} SELECT collector, max(us) AS last_collection,
  count(DISTINCT name) AS metrics_count FROM samples GROUP BY 1""")
def a26(spark, d):
    return sm.collector_status(model.samples(spark, d))


@query("a27_throughput", f"""WITH {SAMPLES_SQL} SELECT collector, us - us % 3600000000 AS window_us,
  round(count(*) / 3600.0, 9) AS per_second FROM samples GROUP BY 1, 2""")
def a27(spark, d):
    return sm.throughput(model.samples(spark, d), 3600, ["collector"]).withColumn(
        "per_second", F.round("per_second", 9))


@query("a28_pool_vectors", """WITH c AS (SELECT vec_id // 4 AS file_id,
  unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT file_id, pos, avg(x) AS m FROM c GROUP BY 1, 2),
n AS (SELECT file_id, sqrt(sum(m * m)) AS n FROM m GROUP BY 1)
SELECT file_id, pos, round(m / n, 6) AS x FROM m JOIN n USING (file_id) WHERE n > 0""")
def a28(spark, d):
    e = model.table(spark, d, "embeddings")
    chunks = e.select(F.expr("vec_id div 4").alias("file_id"),
                      F.col("embedding").cast("array<double>").alias("embedding"))
    return (sm.pool_vectors(chunks).select("file_id", F.posexplode("embedding").alias("pos", "x"))
            .withColumn("x", F.round("x", 6)))


CALLS_SQL = r"""calls AS (SELECT 'chat' AS endpoint, 'm' || (conv_id % 3) AS model,
  CASE WHEN length(a.text) < 200 THEN 'error' ELSE 'ok' END AS status,
  length(a.text) AS response_time_ms, len(string_split(a.text, ' ')) AS tokens
  FROM conversations u JOIN conversations a USING (conv_id)
  WHERE u.role = 'user' AND a.role = 'assistant' AND a.turn = u.turn + 1)"""


def model_calls(spark, d):
    """User turn and the assistant turn that answers it."""
    c = model.table(spark, d, "conversations")
    asked = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"),
                                             F.col("text").alias("prompt"))
    told = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("response"))
    return asked.join(told, ["conv_id", "turn"])


@query("a29_api_metrics", f"""WITH {CALLS_SQL} SELECT endpoint, model, status, count(*) AS calls,
  round(avg(response_time_ms), 6) AS avg_ms, quantile_disc(response_time_ms, 0.95) AS p95_ms,
  CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (status = 'error') AS errors
FROM calls GROUP BY 1, 2, 3""")
def a29(spark, d):
    size = F.length("response")
    points = model_calls(spark, d).select(
        F.lit("chat").alias("endpoint"),
        F.concat(F.lit("m"), F.pmod("conv_id", F.lit(3)).cast("string")).alias("model"),
        F.when(size < 200, "error").otherwise("ok").alias("status"),
        size.cast("long").alias("response_time_ms"),
        F.size(F.split("response", " ")).cast("long").alias("tokens"),
        F.when(size < 200, 1).otherwise(0).cast("long").alias("error_count"))
    return sm.api_metrics(points).withColumn("avg_ms", F.round("avg_ms", 6))


@query("a30_system_points", """SELECT n_name AS service, s_name AS host,
  round(avg(l_quantity), 6) AS avg_cpu_usage, round(avg(l_discount * 100), 6) AS avg_memory_usage,
  round(avg(l_tax * 100), 6) AS avg_disk_usage, max(l_linenumber) AS max_queue_size
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
GROUP BY 1, 2""")
def a30(spark, d):
    line = model.table(spark, d, "lineitem")
    hosts = model.table(spark, d, "supplier").join(
        model.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    points = line.join(hosts, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("n_name").alias("service"), F.col("s_name").alias("host"),
        F.col("l_quantity").alias("cpu_usage"), (F.col("l_discount") * 100).alias("memory_usage"),
        (F.col("l_tax") * 100).alias("disk_usage"), F.col("l_linenumber").alias("queue_size"))
    out = sm.system_points(points)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("avg_")})


@query("a31_rate_limit_audit", f"""WITH {LOG_SQL} SELECT client,
  epoch_us(ts) - epoch_us(ts) % 600000000 AS window_us, count(*) AS requests, count(*) - 1 AS excess
FROM access_log GROUP BY 1, 2 HAVING count(*) > 1""")
def a31(spark, d):
    log = access_log(spark, d).withColumn("us", F.unix_micros("ts"))
    return sm.rate_limit_audit(log, average=0, burst=1, period_s=600)


@query("a32_reduce_series", f"""WITH {SAMPLES_SQL} SELECT name, user_id, round(avg(v), 6) AS mean,
  max(v) AS max, arg_max(v, us) FILTER (v IS NOT NULL) AS "lastNotNull"
FROM (SELECT *, CASE WHEN value < 1 THEN NULL ELSE value END AS v FROM samples) GROUP BY 1, 2""")
def a32(spark, d):
    s = model.samples(spark, d).withColumn("value", F.when(F.col("value") >= 1, F.col("value")))
    return sm.reduce_series(s, ["name", "user_id"], ["mean", "max", "lastNotNull"]).withColumn(
        "mean", F.round("mean", 6))


@query("w01_latest", f"""WITH {SAMPLES_SQL} SELECT name, user_id, arg_max(value, us) AS value,
  max(us) AS us FROM samples GROUP BY 1, 2""")
def w01(spark, d):
    return sm.latest(model.samples(spark, d), ["name", "user_id"])


@query("w10_keep_newest", f"""WITH {SAMPLES_SQL} SELECT name, sample_id, rank_newest FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY us DESC, sample_id DESC) AS rank_newest
  FROM samples) WHERE rank_newest <= 100""")
def w10(spark, d):
    return ordered.keep_newest(model.samples(spark, d), ["name"], ["us", "sample_id"], 100,
                               spread="sample_id").select("name", "sample_id", "rank_newest")


@query("w10_matched_values", f"""WITH {SAMPLES_SQL}, r AS (SELECT *, row_number() OVER (
  PARTITION BY user_id ORDER BY us DESC) AS r FROM samples WHERE k LIKE '1%')
SELECT user_id, string_agg(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY us)
  AS matched_values FROM r WHERE r <= 20 GROUP BY 1""")
def w10b(spark, d):
    s = model.samples(spark, d).filter(F.col("labels")["k"].startswith("1")).withColumn(
        "cents", F.round(F.col("value") * 100).cast("long"))
    out = state.last_values(s, ["user_id"], "cents", ["us", "sample_id"], 20, "sample_id")
    return out.select("user_id", F.array_join(F.col("matched_values").cast("array<string>"), ",")
                      .alias("matched_values"))
