"""D18-D23, A21-A24 on the supplied tables."""

from pyspark.sql import functions as F

from opsloom import model
from opsloom.operators import documents as docs
from opsloom.operators import training as tr
from opsloom.plans.documents import lexicon_sql
from opsloom.plans.registry import query


def training_rows(spark, d):
    return model.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("L"), F.col("label").cast("string"))
        .alias("label"))


@query("d18_encode_labels", """WITH c AS (SELECT o_orderpriority, row_number() OVER (
  ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM orders))
SELECT o_orderkey, code FROM orders JOIN c USING (o_orderpriority)""")
def d18(spark, d):
    return tr.encode_labels(model.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"),
                            "o_orderpriority").select("o_orderkey", "code")


UNLABELLED_SQL = """WITH t AS (SELECT vec_id AS id, CASE WHEN vec_id % 3 <> 0 THEN 'L' || label END AS label,
  md5('42:' || vec_id) AS place FROM embeddings)"""


def unlabelled_rows(spark, d):
    """A third of the rows without a label."""
    return training_rows(spark, d).withColumn("label", F.when(F.col("id") % 3 != 0, F.col("label")))


@query("d18_encode_unlabelled", UNLABELLED_SQL + """, c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code
  FROM (SELECT DISTINCT label FROM t WHERE label IS NOT NULL)) SELECT id, code FROM t LEFT JOIN c USING (label)""")
def d18b(spark, d):
    return tr.encode_labels(unlabelled_rows(spark, d)).select("id", "code")


@query("d19_split_unlabelled", UNLABELLED_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY label
  ORDER BY place, id) AS r, count(*) OVER (PARTITION BY label) AS n FROM t)
SELECT id, label, CASE WHEN r <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r""")
def d19b(spark, d):
    return tr.stratified_split(unlabelled_rows(spark, d)).select("id", "label", "split")


SPLIT_SQL = """WITH t AS (SELECT vec_id AS id, 'L' || label AS label, md5('42:' || vec_id) AS place
  FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY place, id) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM t),
s AS (SELECT id, label, place, CASE WHEN r <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r)"""


@query("d19_stratified_split", SPLIT_SQL + " SELECT id, label, split FROM s")
def d19(spark, d):
    return tr.stratified_split(training_rows(spark, d)).select("id", "label", "split")


@query("d20_assign_batches", SPLIT_SQL + """, i AS (SELECT *, row_number() OVER (PARTITION BY split
  ORDER BY place, id) - 1 AS i FROM s)
SELECT id, split, i % 3 AS worker, (i // 3) // 64 AS batch FROM i""")
def d20(spark, d):
    split = tr.stratified_split(training_rows(spark, d).select("id", "label"))
    return tr.assign_batches(split, 3).select("id", "split", "worker", "batch")


@query("d21_train_classifier")
def d21(spark, d):
    """The table's labels do not depend on its vectors, so SQL can't say which one an unseen row gets."""
    split = tr.stratified_split(training_rows(spark, d))
    net = tr.train_classifier(split.filter("split = 'train'"))
    return tr.score(net, split.filter("split = 'test'")).select("id", "split", "label", "prediction")


@query("d22_score_logistic")
def d22(spark, d):
    split = tr.stratified_split(training_rows(spark, d))
    net = tr.train_classifier(split.filter("split = 'train'"), "logistic")
    return tr.score(net, split).select("id", "split", "label", "prediction")


# Coefficients of three classes for vectors of any length, by place.
GIVEN = {"a": ("((i * 7) % 5 - 2) * 0.5", 0.1), "b": ("((i * 3) % 7 - 3) * 0.25", 0.0),
         "c": ("((i * 11) % 4 - 1) * 0.125", -0.2)}
_DOTS = ", ".join(f"list_sum(list_transform(range(len(e)), lambda i: e[i + 1] * ({w}))) + {b} AS {c}"
                  for c, (w, b) in GIVEN.items())


@query("d22_score_given", f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
m AS (SELECT id, {_DOTS} FROM v)
SELECT id, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS prediction FROM m""")
def d22b(spark, d):
    rows = training_rows(spark, d).select("id", "embedding")
    return tr.score_linear(rows, GIVEN).select("id", "prediction")


def language_predictions(spark, d):
    """Detected language against the language of the table."""
    f = model.files(spark, d)
    return docs.detect_language(f).join(f.select("file_id", "lang"), "file_id").select(
        F.col("lang").alias("label"), F.coalesce("language", F.lit("none")).alias("prediction"))


PRED_SQL = lexicon_sql(docs.STOP_WORDS) + """, p AS (SELECT lang AS label, CASE WHEN hits > 0 THEN name
  ELSE 'none' END AS prediction FROM g JOIN documents ON doc_id = file_id),
cls AS (SELECT label AS class FROM p UNION SELECT prediction FROM p),
per AS (SELECT class, (SELECT count(*) FROM p WHERE label = class) AS support,
  (SELECT count(*) FROM p WHERE prediction = class) AS predicted,
  (SELECT count(*) FROM p WHERE label = class AND prediction = class) AS tp FROM cls),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM per),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
  ELSE 0 END AS f1 FROM m),
report AS (SELECT class, precision, recall, f1, support FROM f
UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support),
  sum(support) FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
  sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)"""


@query("a21_classification_report", PRED_SQL + """ SELECT class, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM report""")
def a21(spark, d):
    out = tr.classification_report(language_predictions(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("a22_confusion_matrix", PRED_SQL + """ SELECT label, prediction, count(*) AS n FROM p
GROUP BY 1, 2""")
def a22(spark, d):
    return tr.confusion_matrix(language_predictions(spark, d))


@query("a22_confusion_wide", PRED_SQL + """ SELECT label, count(*) FILTER (prediction = 'de') AS de,
  count(*) FILTER (prediction = 'en') AS en, count(*) FILTER (prediction = 'es') AS es,
  count(*) FILTER (prediction = 'fr') AS fr, count(*) FILTER (prediction = 'none') AS "none"
FROM p GROUP BY 1""")
def a22b(spark, d):
    return tr.confusion_wide(language_predictions(spark, d), ["de", "en", "es", "fr", "none"])


@query("d23_run_metrics", PRED_SQL + """ SELECT 'run1' AS run, class || '.' || unnest(['precision','recall','f1','support']) AS metric,
  round(unnest([precision, recall, f1, support::DOUBLE]), 6) AS value FROM report""")
def d23(spark, d):
    return tr.run_metrics(language_predictions(spark, d), "run1").withColumn(
        "value", F.round("value", 6))


@query("a23_epoch_metrics", """WITH e AS (SELECT l_linenumber AS epoch, avg(l_discount) AS loss,
  100 * sum(l_quantity) / (count(*) * 50) AS accuracy FROM lineitem GROUP BY 1)
SELECT epoch, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy,
  row_number() OVER (ORDER BY accuracy DESC, epoch) = 1 AS best FROM e""")
def a23(spark, d):
    batches = model.table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("epoch"), F.col("l_discount").alias("loss"),
        F.col("l_quantity").alias("correct"), F.lit(50).alias("total"))
    out = tr.epoch_metrics(batches)
    return out.withColumns({"loss": F.round("loss", 6), "accuracy": F.round("accuracy", 6)})


@query("a24_label_profile", """SELECT vec_id % 4 AS dataset, count(DISTINCT label) AS classes,
  count(*) AS n, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM embeddings GROUP BY 1""")
def a24(spark, d):
    rows = model.table(spark, d, "embeddings").withColumn("dataset", F.pmod("vec_id", F.lit(4)))
    return tr.label_profile(rows)
