"""Write to the shared folder and read back."""

from pyspark.sql import functions as F

from opsloom import model
from opsloom.model import FILES_SQL, SAMPLES_SQL
from opsloom.operators import summary as sm
from opsloom.plans.registry import ORACLES, query
from opsloom.plans.summaries import error_snapshots
from opsloom.session import fresh_dir
from opsloom.sources import files as src_files
from opsloom.sources import samples as src_samples
from opsloom.sources import sinks, snapshots


def rounds(spark, d):
    """Every event as one collection round with a single metric."""
    s = model.samples(spark, d)
    metric = F.struct("value", "labels", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
                      .alias("timestamp"))
    return s.select("collector", F.create_map(F.col("name"), metric).alias("metrics"))


@query("s02_append_samples", f"""WITH {SAMPLES_SQL} SELECT collector, strftime(ts, '%Y-%m-%d') AS day,
  name, count(*) AS n, round(sum(value), 4) AS total, max(us) AS last_us FROM samples GROUP BY 1, 2, 3""")
def s02(spark, d):
    path = fresh_dir(spark, "samples")
    src_samples.append_samples(rounds(spark, d), path)
    back = src_samples.read_samples(spark, path)
    return back.groupBy("collector", F.date_format("date", "yyyy-MM-dd").alias("day"), "name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"),
        F.max(F.unix_micros("ts")).alias("last_us"))


@query("s01_read_samples", f"""WITH {SAMPLES_SQL} SELECT name, us, value, CAST(user_id AS VARCHAR) AS user_id
FROM samples WHERE collector = 'queue' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'""")
def s01(spark, d):
    path = fresh_dir(spark, "samples")
    src_samples.append_samples(rounds(spark, d), path)
    back = src_samples.read_samples(spark, path).filter(
        "collector = 'queue' AND date >= date'2024-01-10' AND date < date'2024-01-20'")
    return back.select("name", F.unix_micros("ts").alias("us"), "value",
                       F.col("labels")["user_id"].alias("user_id"))


@query("s03_scan_files", """SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS suffix,
  strlen(html) + 1 AS file_size, 'txt' AS extension, true AS named, true AS timed FROM pages""")
def s03(spark, d):
    """Pages written as text files, one folder each, and found again by a scan of the tree."""
    path = fresh_dir(spark, "tree")
    pages = model.table(spark, d, "pages")
    suffix = F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1))
    src_files.write_texts(pages.select("page_id", suffix.alias("suffix"), F.col("html").alias("value")),
                          path, ["page_id", "suffix"])
    found = src_files.scan_files(spark, path, "*.txt")
    return found.select(
        F.regexp_extract("path", "page_id=([0-9]+)", 1).cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_extract("path", "suffix=([^/]*)/", 1), "__HIVE_DEFAULT_PARTITION__", "")
        .alias("suffix"), "file_size", "extension",
        (F.col("file_name") == F.element_at(F.split("path", "/"), -1)).alias("named"),
        F.col("modified_at").isNotNull().alias("timed"))


@query("s04_read_stats_json", ORACLES["a15_error_metrics"])
def s04(spark, d):
    path = fresh_dir(spark, "stats")
    error_snapshots(spark, d).write.json(path)
    back = src_files.read_stats_json(spark, path, "snapshot STRING, " + src_files.ERROR_STATS,
                                     multiline=False)
    return sm.error_metrics(back).withColumn("value", F.round("value", 6))


@query("s05_training_set", """SELECT vec_id AS id, 'L' || label AS label, len(embedding) AS dims
FROM embeddings WHERE label >= 5""")
def s05(spark, d):
    path = fresh_dir(spark, "training")
    rows = model.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("L"), F.col("label").cast("string"))
        .alias("label"), F.lit("").alias("text"),
        F.when(F.col("label") >= 5, "high").otherwise("low").alias("dataset"))
    sinks.write_training(rows, path)
    out = sinks.extract_training(spark, path, "high", "id LONG, embedding ARRAY<FLOAT>, "
                                 "label STRING, text STRING, dataset STRING")
    return out.select("id", "label", F.size("embedding").alias("dims"))


@query("s06_read_sidecars", f"""WITH {FILES_SQL} SELECT source, count(*) AS n,
  CAST(sum(file_size) AS BIGINT) AS bytes FROM files GROUP BY 1""")
def s06(spark, d):
    """One sidecar table per source folder: the folder name is the key the path carries."""
    path = fresh_dir(spark, "sidecars")
    f = model.files(spark, d).select("source", "file_id", "file_size", "priority")
    f.write.option("compression", "none").partitionBy("source").json(path)
    side = src_files.read_sidecars(spark, path, "file_id LONG, file_size LONG, priority STRING",
                                   "*.json", "/source=([^/]+)/", multiline=False)
    return side.groupBy(F.col("path").alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"))


@query("s07_report_csv", """WITH r AS (SELECT event_type AS name, count(*) AS n, max(value) AS hi
  FROM events GROUP BY 1) SELECT name, 'usage_max' AS path_key, CAST(CAST(round(hi * 100) AS BIGINT) AS VARCHAR) AS value
FROM r UNION ALL SELECT name, 'n', CAST(n AS VARCHAR) FROM r""")
def s07(spark, d):
    path = fresh_dir(spark, "report")
    report = model.samples(spark, d).groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("hi")).select(
        "name", "n", F.struct(F.round(F.col("hi") * 100).cast("long").alias("max")).alias("usage"))
    sinks.write_report_csv(report, path, ["name"])
    return spark.read.schema("name STRING, path_key STRING, value STRING").option(
        "header", "true").csv(path)


@query("s08_artifacts", """SELECT lang AS label, source AS prediction, count(*) AS n FROM documents
GROUP BY 1, 2""")
def s08(spark, d):
    path = fresh_dir(spark, "artifacts")
    cells = model.table(spark, d, "documents").groupBy(
        F.col("lang").alias("label"), F.col("source").alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))
    sinks.write_artifacts(path, confusion_matrix=cells)
    return spark.read.schema("label STRING, prediction STRING, n LONG").option(
        "header", "true").csv(f"{path}/confusion_matrix.csv")


def alert_state(spark, d):
    return model.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("alert_id")).agg(
        F.max("o_totalprice").alias("value"), F.count(F.lit(1)).alias("n"))


@query("s17_snapshot_restore", """SELECT o_custkey AS alert_id, max(o_totalprice) AS value,
  count(*) AS n FROM orders GROUP BY 1""")
def s17(spark, d):
    root = fresh_dir(spark, "backup")
    state = alert_state(spark, d)
    stamp = snapshots.snapshot(state, root, "daily", "2024-01-05 03:00:00")
    damaged = state.filter("n > 5")
    return snapshots.restore(spark, root, "daily", stamp, damaged, f"{root}/current",
                             "2024-01-06 03:00:00")


@query("s16_snapshots", """SELECT 'daily' AS kind, '20240105_030000' AS stamp,
  count(DISTINCT o_custkey) AS row_count, TRUE AS ok FROM orders
UNION ALL SELECT 'daily', '20240106_030000', count(DISTINCT o_custkey), TRUE FROM orders""")
def s16(spark, d):
    root = fresh_dir(spark, "backup")
    state = alert_state(spark, d)
    for day in ("05", "06"):
        snapshots.snapshot(state, root, "daily", f"2024-01-{day} 03:00:00")
    ok = snapshots.verify_snapshot(spark, root, "daily", "20240106_030000", state.schema).agg(
        F.bool_and("ok").alias("ok"))
    return (snapshots.list_snapshots(spark, root, "daily").select("kind", "stamp", "row_count")
            .withColumn("ok", ok.scalar()))
