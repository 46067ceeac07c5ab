"""A12-A14, A17, A18, W09, J11 on the supplied tables."""

from pyspark.sql import functions as F

from opsloom import model
from opsloom.model import COUNTERS_SQL, SAMPLES_SQL
from opsloom.operators import panels as pn
from opsloom.plans.registry import query

BUCKETS = [10.0, 50.0, 100.0, 200.0, 300.0]
# Queue wait buckets in seconds.
WAIT_BUCKETS = [30.0, 60.0, 300.0, 600.0, 1800.0, 3600.0]
HIST_SQL = f"""WITH {SAMPLES_SQL}, b AS (SELECT unnest([10.0, 50.0, 100.0, 200.0, 300.0, 'inf'::DOUBLE])
  AS bound), h AS (SELECT name, bound, count(*) FILTER (value <= bound) AS cum_count,
  count(value) AS count, sum(value) AS sum FROM samples, b GROUP BY 1, 2)"""


@query("a12_histogram", HIST_SQL + """ SELECT name, CASE WHEN bound = 'inf'::DOUBLE THEN '+Inf'
  ELSE CAST(CAST(bound AS INT) AS VARCHAR) END AS le, cum_count, count, round(sum, 4) AS sum FROM h""")
def a12(spark, d):
    return pn.histogram(model.samples(spark, d), BUCKETS, ["name"]).withColumn(
        "sum", F.round("sum", 4))


@query("a13_histogram_quantile", HIST_SQL + """, q AS (SELECT unnest([0.5, 0.95, 0.999]) AS q),
x AS (SELECT name, q, bound, cum_count, q * count AS want,
  coalesce(lag(bound) OVER (PARTITION BY name, q ORDER BY bound), 0) AS low,
  coalesce(lag(cum_count) OVER (PARTITION BY name, q ORDER BY bound), 0) AS before FROM h, q)
SELECT name, CAST(q AS DOUBLE) AS q, round(arg_min(CASE WHEN bound = 'inf'::DOUBLE THEN low ELSE
  low + (bound - low) * (want - before) / (cum_count - before) END, bound), 6) AS quantile
FROM x WHERE cum_count >= want GROUP BY 1, 2""")
def a13(spark, d):
    h = pn.histogram(model.samples(spark, d), BUCKETS, ["name"])
    out = [pn.histogram_quantile(h, q, ["name"]) for q in (0.5, 0.95, 0.999)]
    return out[0].unionByName(out[1]).unionByName(out[2]).withColumn(
        "quantile", F.round("quantile", 6))


DELTA_SQL = f"""WITH {COUNTERS_SQL}, p AS (SELECT *, lag(counter) OVER (
  PARTITION BY name, instance ORDER BY us, sample_id) AS prev FROM counters),
deltas AS (SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN counter < prev THEN counter
  ELSE counter - prev END AS delta FROM p)"""


@query("w09_counter_rate", DELTA_SQL + """ SELECT sample_id, round(sum(delta) OVER (
  PARTITION BY name, instance ORDER BY us RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW)
  / 21600, 9) AS rate FROM deltas""")
def w09(spark, d):
    return pn.counter_rate(model.counters(spark, d), ["name", "instance"], 21600).select(
        "sample_id", F.round("rate", 9).alias("rate"))


@query("a14_sum_by", DELTA_SQL + """, r AS (SELECT name, instance, us - us % 21600000000 AS step_us,
  sum(delta) / 21600 AS rate FROM deltas GROUP BY 1, 2, 3)
SELECT name, step_us, round(sum(rate), 9) AS rate FROM r GROUP BY 1, 2""")
def a14(spark, d):
    rates = pn.step_rates(model.counters(spark, d), ["name", "instance"], 21600)
    return pn.sum_by(rates, ["name", "step_us"]).withColumn("rate", F.round("rate", 9))


@query("j11_error_ratio", DELTA_SQL + """, r AS (SELECT name, instance, us - us % 21600000000 AS step_us,
  sum(delta) / 21600 AS rate FROM deltas GROUP BY 1, 2, 3),
f AS (SELECT * FROM r WHERE name = 'error'), s AS (SELECT * FROM r WHERE name = 'view'),
t AS (SELECT step_us, sum(rate) AS f FROM f GROUP BY 1),
b AS (SELECT f.step_us, sum(f.rate + s.rate) AS t FROM f JOIN s
      ON s.instance = f.instance AND s.step_us = f.step_us GROUP BY 1)
SELECT step_us, round(CASE WHEN b.t <> 0 THEN t.f / b.t END, 9) AS error_ratio
FROM t JOIN b USING (step_us)""")
def j11(spark, d):
    rates = pn.step_rates(model.counters(spark, d).filter("name IN ('error', 'view')"),
                          ["name", "instance"], 21600)
    return pn.error_share(rates, F.col("name") == "error", F.col("name") == "view",
                          ["instance"]).withColumn("error_ratio", F.round("error_ratio", 9))


@query("j11_error_ratio_unlabelled", DELTA_SQL + """, r AS (SELECT name, CASE WHEN instance % 3 <> 0 THEN instance
  END AS instance, us - us % 21600000000 AS step_us, sum(delta) / 21600 AS rate FROM deltas GROUP BY 1, 2, 3),
f AS (SELECT * FROM r WHERE name = 'error'), s AS (SELECT * FROM r WHERE name = 'view'),
t AS (SELECT instance, step_us, sum(rate) AS f FROM f GROUP BY 1, 2),
b AS (SELECT f.instance, f.step_us, sum(f.rate + s.rate) AS t FROM f JOIN s
      ON s.instance IS NOT DISTINCT FROM f.instance AND s.step_us = f.step_us GROUP BY 1, 2)
SELECT t.instance, t.step_us, round(CASE WHEN b.t <> 0 THEN t.f / b.t END, 9) AS error_ratio
FROM t JOIN b ON t.instance IS NOT DISTINCT FROM b.instance AND t.step_us = b.step_us""")
def j11b(spark, d):
    """Series that lost their label count together under NULL."""
    kept = F.when(F.col("instance") % 3 != 0, F.col("instance"))
    rates = (pn.step_rates(model.counters(spark, d).filter("name IN ('error', 'view')"), ["name", "instance"], 21600)
             .groupBy("name", kept.alias("instance"), "step_us").agg(F.sum("rate").alias("rate")))
    return pn.error_share(rates, F.col("name") == "error", F.col("name") == "view", ["instance"],
                          ["instance"]).withColumn("error_ratio", F.round("error_ratio", 9))


@query("a17_panel", f"""WITH {SAMPLES_SQL} SELECT us - us % 86400000000 AS step_us, k,
  round(avg(value), 6) AS value FROM samples WHERE name = 'purchase'
  AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-28' GROUP BY 1, 2""")
def a17(spark, d):
    target = {"metric": "purchase", "aggregation": "mean", "groupBy": ["k"]}
    return pn.panel(model.samples(spark, d), target, "2024-01-03", "2024-01-28",
                    step_s=86400).withColumn("value", F.round("value", 6))


@query("a17_panel_histogram", HIST_SQL + """ SELECT CASE WHEN bound = 'inf'::DOUBLE THEN '+Inf'
  ELSE CAST(CAST(bound AS INT) AS VARCHAR) END AS le, cum_count, count, round(sum, 4) AS sum FROM h
WHERE name = 'click'""")
def a17b(spark, d):
    target = {"metric": "click", "aggregation": "histogram", "buckets": BUCKETS}
    return pn.panel(model.samples(spark, d), target).withColumn("sum", F.round("sum", 4))


@query("a18_heatmap", f"""WITH {SAMPLES_SQL} SELECT us - us % 3600000000 AS step_us,
  CASE WHEN value <= 10 THEN '10' WHEN value <= 50 THEN '50' WHEN value <= 100 THEN '100'
       WHEN value <= 200 THEN '200' WHEN value <= 300 THEN '300' ELSE '+Inf' END AS le,
  count(*) AS n FROM samples GROUP BY 1, 2""")
def a18(spark, d):
    return pn.heatmap(model.samples(spark, d), 3600, BUCKETS)


@query("s14_exposition", f"""WITH {SAMPLES_SQL}, h AS (SELECT collector, b.bound,
  count(*) FILTER (value <= b.bound) AS n FROM samples,
  (SELECT unnest([10, 50, 100, 200, 300, 'inf'::DOUBLE]) AS bound) b WHERE name = 'purchase' GROUP BY 1, 2)
SELECT 'error' AS metric, 'gauge' AS type, collector, NULL AS le, arg_max(value, us) AS value
  FROM samples WHERE name = 'error' GROUP BY collector
UNION ALL SELECT 'view', 'counter', collector, NULL, round(sum(value), 4)
  FROM samples WHERE name = 'view' GROUP BY collector
UNION ALL SELECT 'purchase_bucket', 'histogram', collector,
  CASE WHEN bound = 'inf'::DOUBLE THEN '+Inf' ELSE CAST(CAST(bound AS INT) AS VARCHAR) END, n FROM h
UNION ALL SELECT 'purchase_sum', 'histogram', collector, NULL, round(sum(value), 4) FROM samples
  WHERE name = 'purchase' GROUP BY collector
UNION ALL SELECT 'purchase_count', 'histogram', collector, NULL, count(*) FROM samples
  WHERE name = 'purchase' GROUP BY collector""")
def s14(spark, d):
    defs = [{"name": "error", "type": "gauge"}, {"name": "view", "type": "counter"},
            {"name": "purchase", "type": "histogram", "buckets": BUCKETS}]
    return pn.exposition(model.samples(spark, d), defs, ["collector"]).withColumn(
        "value", F.round("value", 4))
