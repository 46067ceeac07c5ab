"""Table shapes and the binding of the supplied tables to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.session import cut, spread

METRIC_SAMPLES = ("sample_id LONG, name STRING, value DOUBLE, labels MAP<STRING,STRING>, "
                  "ts TIMESTAMP, collector STRING")
EVENTS = ("event_id LONG, ts TIMESTAMP, user_id LONG, event_type STRING, value DOUBLE, "
          "props STRING")
METRIC_DEFS = ("collector STRING, name STRING, type STRING, description STRING, "
               "labels ARRAY<STRING>, buckets ARRAY<DOUBLE>, interval_s INT")
ALERT_RULES = ("rule STRING, metric STRING, comparison STRING, severity STRING, threshold DOUBLE, "
               "duration_s INT, cooldown_s INT, channels ARRAY<STRING>")

# Tables with long texts and their row keys; small ones are spread over the cores.
TEXT_KEYS = {"documents": ("doc_id",), "pages": ("page_id",), "conversations": ("conv_id", "turn")}

# Extension, mime type and processor by file number modulo 5.
FILE_KINDS = [("txt", "text/plain"), ("html", "text/html"), ("pdf", "application/pdf"),
              ("jpg", "image/jpeg"), ("mp4", "video/mp4")]


def table(spark: SparkSession, sf_dir: str, name: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    scan = reader.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan, *TEXT_KEYS[name]) if name in TEXT_KEYS else scan


def as_samples(events: DataFrame) -> DataFrame:
    """Events as metric samples; hot labels are also columns so filters can reach the scan."""
    collector = (F.when(F.col("event_type").isin("view", "click"), "pipeline")
                 .when(F.col("event_type").isin("purchase", "signup"), "queue")
                 .otherwise("system"))
    labels = F.map_concat(F.from_json("props", "map<string,string>"),
                          F.create_map(F.lit("user_id"), F.col("user_id").cast("string")))
    return events.select(
        F.col("event_id").alias("sample_id"), F.col("event_type").alias("name"), "value",
        labels.alias("labels"), "ts", collector.alias("collector"),
        F.unix_micros("ts").alias("us"), "user_id")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_samples(table(spark, sf_dir, "events", EVENTS))


SAMPLES_SQL = """samples AS (
  SELECT event_id AS sample_id, event_type AS name, value, ts, epoch_us(ts) AS us, user_id,
         json_extract_string(props, '$.k') AS k,
         CASE WHEN event_type IN ('view','click') THEN 'pipeline'
              WHEN event_type IN ('purchase','signup') THEN 'queue' ELSE 'system' END AS collector
  FROM events)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as processed files."""
    doc = table(spark, sf_dir, "documents")
    kind = F.pmod("doc_id", F.lit(5))
    ext = F.element_at(F.array(*[F.lit(e) for e, _ in FILE_KINDS]), (kind + 1).cast("int"))
    mime = F.element_at(F.array(*[F.lit(m) for _, m in FILE_KINDS]), (kind + 1).cast("int"))
    priority = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")),
                            (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    named = doc.select(
        F.col("doc_id").alias("file_id"), "text", "lang", "source",
        F.col("n_chars").alias("file_size"), ext.alias("extension"), mime.alias("mime_type"),
        priority.alias("priority"), F.md5("text").alias("md5_hash"),
        F.concat_ws(".", F.lpad(F.pmod(F.col("doc_id") * 37, F.lit(1000)).cast("string"), 3, "0"),
                    F.lpad(F.pmod("doc_id", F.lit(100)).cast("string"), 2, "0"))
        .alias("dewey_decimal"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("created_at"))
    return (named
            .withColumn("file_name", F.concat_ws(".", F.col("file_id").cast("string"), "extension"))
            .withColumn("file_path", F.concat_ws("/", "source", "lang", "file_name"))
            .withColumn("tags", F.array("lang", "source"))
            .withColumn("categories", F.array(F.split_part("mime_type", F.lit("/"), F.lit(1)))))


FILES_SQL = """files AS (
  SELECT *, file_id || '.' || extension AS file_name,
         source || '/' || lang || '/' || file_id || '.' || extension AS file_path,
         split_part(mime_type, '/', 1) AS category
  FROM (SELECT doc_id AS file_id, text, lang, source, n_chars AS file_size,
          ['txt','html','pdf','jpg','mp4'][(doc_id % 5) + 1] AS extension,
          ['text/plain','text/html','application/pdf','image/jpeg','video/mp4'][(doc_id % 5) + 1]
            AS mime_type,
          ['high','medium','low'][(doc_id % 3) + 1] AS priority, md5(text) AS md5_hash,
          lpad(CAST((doc_id * 37) % 1000 AS VARCHAR), 3, '0') || '.' ||
            lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') AS dewey_decimal,
          1704067200 + doc_id * 60 AS created_s
        FROM documents))"""


def queue_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as queue items; an item is done when its last line has shipped."""
    order = table(spark, sf_dir, "orders")
    line = table(spark, sf_dir, "lineitem")
    shipped = line.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.max("l_shipdate").alias("done_at"), F.count(F.lit(1)).alias("attempts"))
    priority = (F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high")
                .when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low"))
    status = (F.when(F.col("o_orderstatus") == "F", "done")
              .when(F.col("o_orderstatus") == "P", "failed").otherwise("pending"))
    items = order.select(
        F.col("o_orderkey").alias("id"), priority.alias("priority"), status.alias("status"),
        F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("cost"),
        F.concat(F.lit("processor_"), F.pmod("o_custkey", F.lit(8)).cast("string"))
        .alias("processor"))
    return items.join(shipped, "id", "left").withColumn("max_attempts", F.lit(3))


QUEUE_SQL = """items AS (
  SELECT o_orderkey AS id,
    CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'high'
         WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority,
    CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status,
    o_orderdate AS created_at, o_totalprice AS cost,
    'processor_' || CAST(o_custkey % 8 AS VARCHAR) AS processor, done_at, attempts,
    3 AS max_attempts
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS done_at, count(*) AS attempts
                         FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter series ``(name, instance)`` that start again every 500 samples of the input.

    Counters arrive as a stored table in practice, so the derived one is written once as well.
    """
    from opsloom.operators.ordered import by_time, running_sum
    s = samples(spark, sf_dir).select(
        "sample_id", "name", F.pmod("user_id", F.lit(8)).alias("instance"), "us", "value",
        F.expr("sample_id div 500").alias("life"))
    ran = running_sum(s, ["name", "instance", "life"], ["us", "sample_id"],
                      {"counter": F.col("value")}, by_time("us"))
    return cut(ran.select("sample_id", "name", "instance", "us", "counter"), "counters")


COUNTERS_SQL = """counters AS (
  SELECT event_id AS sample_id, event_type AS name, user_id % 8 AS instance, epoch_us(ts) AS us,
    sum(value) OVER (PARTITION BY event_type, user_id % 8, event_id // 500
                     ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS counter
  FROM events)"""
