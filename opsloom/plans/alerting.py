"""J03, J04, J10, J13, W02-W08, W11-W13, A19, U03, S18 on the supplied tables."""

from pyspark.sql import functions as F

from opsloom import model
from opsloom.model import SAMPLES_SQL
from opsloom.operators import episodes as ep
from opsloom.operators import rules as rl
from opsloom.operators import state
from opsloom.operators import summary as sm
from opsloom.plans.registry import query
from opsloom.session import small_table

RULES = [("hot_view", "view", "greater", "warning", 30.0, 3600, 21600, ["slack", "email"]),
         ("cold_click", "click", "less", "critical", 60.0, 1800, 43200, ["slack"]),
         ("flat_error", "error", "equal", "warning", 6.55, 0, 3600, ["email", "pagerduty"]),
         ("any_error", "error", "greater", "critical", 5.0, 0, 86400, ["slack", "pagerduty"])]
RULES_SQL = """rules(rule, metric, comparison, severity, threshold, duration_s, cooldown_s) AS (VALUES
  ('hot_view','view','greater','warning',30.0::DOUBLE,3600,21600),
  ('cold_click','click','less','critical',60.0,1800,43200),
  ('flat_error','error','equal','warning',6.55,0,3600),
  ('any_error','error','greater','critical',5.0,0,86400))"""
HELD_SQL = f"""WITH {SAMPLES_SQL}, {RULES_SQL}, v AS (SELECT s.*, r.* EXCLUDE (metric),
  CASE comparison WHEN 'greater' THEN value > threshold WHEN 'less' THEN value < threshold
       WHEN 'equal' THEN abs(value - threshold) < 0.0001 ELSE FALSE END AS violated
  FROM samples s JOIN rules r ON r.metric = s.name),
g AS (SELECT *, sum(CASE WHEN violated THEN 0 ELSE 1 END) OVER (PARTITION BY rule
  ORDER BY us, sample_id ROWS UNBOUNDED PRECEDING) AS island FROM v),
h AS (SELECT *, CASE WHEN violated THEN min(CASE WHEN violated THEN us END) OVER (
  PARTITION BY rule, island) END AS run_start FROM g),
held AS (SELECT *, violated AND us - run_start >= duration_s::BIGINT * 1000000 AS fires FROM h)"""


def rules(spark):
    return small_table(spark, model.ALERT_RULES, RULES)


def held(spark, d):
    return rl.threshold_rule(model.samples(spark, d), rules(spark))


@query("w05_threshold_hold", HELD_SQL + """ SELECT rule, sample_id, violated, run_start, fires
FROM held""")
def w05(spark, d):
    return held(spark, d).select("rule", "sample_id", "violated", "run_start", "fires")


@query("w02_rate_rule", f"""WITH {SAMPLES_SQL}, f AS (SELECT name, sample_id, us, value,
  min(us) OVER w AS t0, first_value(value) OVER w AS v0 FROM samples
  WINDOW w AS (PARTITION BY name ORDER BY us RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW))
SELECT name, sample_id, round(CASE WHEN us > t0 THEN (value - v0) / ((us - t0) / 1e6) END, 9) AS rate,
  coalesce(CASE WHEN us > t0 THEN abs((value - v0) / ((us - t0) / 1e6)) > 0.02 END, FALSE) AS fires
FROM f""")
def w02(spark, d):
    return rl.rate_rule(model.samples(spark, d), ["name"], 0.02, 7200).select(
        "name", "sample_id", F.round("rate", 9).alias("rate"), "fires")


@query("w03_relative_change", f"""WITH {SAMPLES_SQL}, p AS (SELECT *, lag(value) OVER (
  PARTITION BY name, user_id ORDER BY us, sample_id) AS prev FROM samples)
SELECT sample_id, round(CASE WHEN prev <> 0 THEN abs(value - prev) / abs(prev) END, 6) AS change,
  coalesce(CASE WHEN prev <> 0 THEN abs(value - prev) / abs(prev) > 0.5 END, FALSE) AS fires FROM p""")
def w03(spark, d):
    return rl.relative_change(model.samples(spark, d), ["name", "user_id"], 0.5).select(
        "sample_id", F.round("change", 6).alias("change"), "fires")


@query("w04_pattern_rule", f"""WITH {SAMPLES_SQL}, m AS (SELECT *, regexp_matches(k, '^[1-5]') AS matched
  FROM samples), c AS (SELECT *, sum(CASE WHEN matched THEN 1 ELSE 0 END) OVER (PARTITION BY name
  ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS matches FROM m)
SELECT sample_id, CAST(matches AS BIGINT) AS matches, matched AND matches >= 3 AS fires FROM c""")
def w04(spark, d):
    log = model.samples(spark, d).select("sample_id", "name", "us", F.col("labels")["k"].alias("line"))
    return rl.pattern_rule(log, ["name"], "line", "^[1-5]", 3, 3600).select(
        "sample_id", "matches", "fires")


@query("w04_pattern_hold", f"""WITH {SAMPLES_SQL}, m AS (SELECT *, regexp_matches(k, '^[1-5]') AS matched
  FROM samples), c AS (SELECT *, sum(CASE WHEN matched THEN 1 ELSE 0 END) OVER (PARTITION BY name
  ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) >= 2 AS enough FROM m),
g AS (SELECT *, sum(CASE WHEN enough THEN 0 ELSE 1 END) OVER (PARTITION BY name
  ORDER BY us, sample_id ROWS UNBOUNDED PRECEDING) AS island FROM c),
h AS (SELECT *, min(CASE WHEN enough THEN us END) OVER (PARTITION BY name, island) AS t0 FROM g)
SELECT sample_id, enough AND matched AND us - t0 >= 1200000000 AS fires FROM h""")
def w04b(spark, d):
    log = model.samples(spark, d).select("sample_id", "name", "us", F.col("labels")["k"].alias("line"))
    return rl.pattern_rule(log, ["name"], "line", "^[1-5]", 2, 3600, duration_s=1200).select(
        "sample_id", "fires")


@query("w06_cooldown_gap", HELD_SQL + """, p AS (SELECT *, lag(us) OVER (PARTITION BY rule
  ORDER BY us, sample_id) AS prev FROM held WHERE violated)
SELECT rule, sample_id, prev IS NULL OR us - prev > 3600000000 AS notify FROM p""")
def w06(spark, d):
    return rl.cooldown_gap(held(spark, d).filter("violated"), ["rule"], 3600).select(
        "rule", "sample_id", "notify")


@query("w07_cooldown_sent", HELD_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
v2 AS (SELECT rule, us FROM held WHERE violated),
sent(rule, us) AS (SELECT rule, min(us) FROM v2 GROUP BY rule
  UNION ALL SELECT s.rule, (SELECT min(v2.us) FROM v2 WHERE v2.rule = s.rule
    AND v2.us > s.us + 21600000000) FROM sent s WHERE s.us IS NOT NULL)
SELECT rule, us FROM sent WHERE us IS NOT NULL""")
def w07(spark, d):
    return rl.cooldown_sent(held(spark, d).filter("violated"), ["rule"], 21600,
                            slice_s=43200).select("rule", "us")


@query("w11_gaps", f"""WITH {SAMPLES_SQL}, defs(collector, interval_s) AS (VALUES ('queue', 30),
  ('system', 60), ('pipeline', 30)), p AS (SELECT *, (us - lag(us) OVER (PARTITION BY name
  ORDER BY us, sample_id)) / 1e6 AS gap_s FROM samples)
SELECT name, sample_id, round(gap_s, 6) AS gap_s, interval_s FROM p JOIN defs USING (collector)
WHERE gap_s > 60 * interval_s""")
def w11(spark, d):
    defs = small_table(spark, "collector STRING, interval_s INT",
                       [("queue", 30), ("system", 60), ("pipeline", 30)])
    return rl.gaps(model.samples(spark, d), defs, ["name"], 60).select(
        "name", "sample_id", F.round("gap_s", 6).alias("gap_s"), "interval_s")


@query("j03_check_alerts", f"""WITH {SAMPLES_SQL}, {RULES_SQL}, l AS (SELECT user_id, name,
  arg_max(value, us) AS value FROM samples GROUP BY 1, 2)
SELECT rule, user_id, value, threshold FROM l JOIN rules ON metric = name WHERE value > threshold""")
def j03(spark, d):
    last = sm.latest(model.samples(spark, d), ["user_id", "name"])
    return rl.check_alerts(last, rules(spark)).select("rule", "user_id", "value", "threshold")


COMPOSITES = [
    ("both_hot", "AND", 1800, [{"type": "threshold", "metric": "view", "comparison": "greater",
                                "threshold": 20.0},
                               {"type": "threshold", "metric": "error", "comparison": "greater",
                                "threshold": 20.0}]),
    ("any_cold", "OR", 0, [{"type": "threshold", "metric": "click", "comparison": "less",
                            "threshold": 5.0},
                           {"type": "threshold", "metric": "no_such_metric",
                            "comparison": "less", "threshold": 5.0},
                           {"type": "threshold", "metric": "signup", "comparison": "less",
                            "threshold": 5.0}]),
    ("odd", "XOR", 0, [{"type": "threshold", "metric": "click", "comparison": "greater",
                        "threshold": 0.0}]),
]
COMPOSITE_SCHEMA = ("rule STRING, operator STRING, duration_s INT, conditions "
                    "ARRAY<STRUCT<type:STRING,metric:STRING,comparison:STRING,threshold:DOUBLE>>")
COMPOSITE_SQL = f"""WITH {SAMPLES_SQL}, cond(rule, operator, duration_s, pos, metric, comparison, threshold) AS (VALUES
  ('both_hot','AND',1800,0,'view','greater',20.0::DOUBLE), ('both_hot','AND',1800,1,'error','greater',20.0),
  ('any_cold','OR',0,0,'click','less',5.0), ('any_cold','OR',0,1,'no_such_metric','less',5.0),
  ('any_cold','OR',0,2,'signup','less',5.0), ('odd','XOR',0,0,'click','greater',0.0)),
t AS (SELECT DISTINCT c.rule, s.sample_id, s.us FROM samples s JOIN cond c ON c.metric = s.name),
vals AS (SELECT t.*, c.operator, c.duration_s, c.pos, c.metric, c.comparison, c.threshold, s.value
  FROM (SELECT t.*, c2.metric AS m2 FROM t JOIN cond c2 USING (rule)) t
  JOIN cond c ON c.rule = t.rule AND c.metric = t.m2
  ASOF JOIN samples s ON s.name = t.m2 AND t.us >= s.us),
ev AS (SELECT rule, operator, duration_s, sample_id, us, CASE operator WHEN 'AND' THEN bool_and(ok)
  WHEN 'OR' THEN bool_or(ok) ELSE FALSE END AS violated,
  coalesce(string_agg(metric, ',' ORDER BY pos) FILTER (ok), '') AS triggered FROM (SELECT *,
    CASE comparison WHEN 'greater' THEN value > threshold ELSE value < threshold END AS ok FROM vals)
  GROUP BY 1, 2, 3, 4, 5)"""


def composites(spark):
    return small_table(spark, COMPOSITE_SCHEMA, COMPOSITES)


@query("j13_asof_values", COMPOSITE_SQL + " SELECT rule, sample_id, pos, metric, value FROM vals")
def j13(spark, d):
    return rl.composite_values(model.samples(spark, d), composites(spark)).select(
        "rule", F.col("tick_id").alias("sample_id"), "pos", "metric", "value")


@query("j04_composite_eval", COMPOSITE_SQL + " SELECT rule, sample_id, violated, triggered FROM ev")
def j04(spark, d):
    out = rl.composite_eval(rl.composite_values(model.samples(spark, d), composites(spark)))
    return out.select("rule", F.col("tick_id").alias("sample_id"), "violated",
                      F.array_join(F.transform("triggered", lambda c: c["metric"]), ",")
                      .alias("triggered"))


@query("w12_triggered_conditions", COMPOSITE_SQL + """ SELECT rule, sample_id, metric, threshold,
  value FROM vals JOIN ev USING (rule, sample_id) WHERE ev.violated AND
  CASE comparison WHEN 'greater' THEN value > threshold ELSE value < threshold END""")
def w12(spark, d):
    out = rl.composite_eval(rl.composite_values(model.samples(spark, d), composites(spark)))
    return (out.filter("violated").select("rule", F.col("tick_id").alias("sample_id"),
                                          F.explode("triggered").alias("c"))
            .select("rule", "sample_id", "c.metric", "c.threshold", "c.value"))


@query("w13_composite_hold", COMPOSITE_SQL + """, g AS (SELECT *, sum(CASE WHEN violated THEN 0
  ELSE 1 END) OVER (PARTITION BY rule ORDER BY us, sample_id ROWS UNBOUNDED PRECEDING) AS island FROM ev)
SELECT rule, sample_id, violated AND us - min(CASE WHEN violated THEN us END) OVER (
  PARTITION BY rule, island) >= duration_s::BIGINT * 1000000 AS fires FROM g""")
def w13(spark, d):
    return rl.composite_rule(model.samples(spark, d), composites(spark)).select(
        "rule", "sample_id", "fires")


EPISODE_SQL = HELD_SQL + """, ev AS (
  SELECT rule, us, sample_id, 0 AS resolve, value FROM held WHERE fires
  UNION ALL SELECT r.rule, s.us, s.sample_id, 1, NULL FROM samples s, rules r
    WHERE s.name = 'signup' AND s.value > 150),
n AS (SELECT *, sum(resolve) OVER (PARTITION BY rule ORDER BY us, sample_id, resolve
  ROWS UNBOUNDED PRECEDING) - resolve AS episode FROM ev),
eps AS (SELECT rule, episode, count(*) FILTER (resolve = 0) AS fires,
  min(us) FILTER (resolve = 0) AS opened_us, max(us) FILTER (resolve = 0) AS last_fire_us,
  arg_max(value, us) FILTER (resolve = 0) AS final_value,
  max(value) FILTER (resolve = 0) AS peak_value, max(us) FILTER (resolve = 1) AS resolved_us
  FROM n GROUP BY 1, 2 HAVING count(*) FILTER (resolve = 0) > 0)"""


def episodes(spark, d):
    h = held(spark, d)
    resolved = (model.samples(spark, d).filter("name = 'signup' AND value > 150")
                .select("us", "sample_id",
                        F.explode(F.array(*[F.lit(r[0]) for r in RULES])).alias("rule")))
    return ep.alert_episodes(h.filter("fires"), resolved, ["rule"])


@query("w08_episodes", EPISODE_SQL + """ SELECT rule, fires, opened_us, last_fire_us, final_value,
  peak_value, resolved_us, CASE WHEN resolved_us IS NULL THEN 'active' ELSE 'resolved' END AS status,
  round((resolved_us - opened_us) / 1e6, 6) AS duration_s FROM eps""")
def w08(spark, d):
    return episodes(spark, d).withColumn("duration_s", F.round("duration_s", 6))


@query("w08_auto_resolve", HELD_SQL + """, ev AS (
  SELECT rule, us, sample_id, 0 AS resolve FROM held WHERE fires
  UNION ALL SELECT rule, us, sample_id, 1 FROM (SELECT *, lag(violated) OVER (PARTITION BY rule
    ORDER BY us, sample_id) AS was FROM held) WHERE NOT violated AND was),
n AS (SELECT *, sum(resolve) OVER (PARTITION BY rule ORDER BY us, sample_id, resolve
  ROWS UNBOUNDED PRECEDING) - resolve AS episode FROM ev)
SELECT rule, count(*) FILTER (resolve = 0) AS fires, min(us) FILTER (resolve = 0) AS opened_us,
  max(us) FILTER (resolve = 1) AS resolved_us FROM n GROUP BY rule, episode
HAVING count(*) FILTER (resolve = 0) > 0""")
def w08b(spark, d):
    h = held(spark, d)
    return ep.alert_episodes(h.filter("fires"), ep.auto_resolves(h, ["rule"]), ["rule"]).select(
        "rule", "fires", "opened_us", "resolved_us")


@query("a19_alert_status", EPISODE_SQL + """ SELECT rule AS handler,
  count(*) FILTER (resolved_us IS NULL) AS active, CAST(sum(fires) AS BIGINT) AS total_triggered
FROM eps GROUP BY 1""")
def a19(spark, d):
    return ep.alert_status(episodes(spark, d).withColumnRenamed("rule", "handler"))


@query("u03_all_history", HELD_SQL + """ SELECT 'threshold' AS handler, rule AS name, sample_id
FROM held WHERE fires UNION ALL SELECT 'pattern', name, sample_id FROM samples
WHERE k LIKE '9%' AND name = 'error'""")
def u03(spark, d):
    pattern = model.samples(spark, d).filter("name = 'error'").filter(
        F.col("labels")["k"].startswith("9")).select("name", "sample_id")
    fired = held(spark, d).filter("fires").select(F.col("rule").alias("name"), "sample_id")
    return state.all_history(threshold=fired, pattern=pattern)


@query("s18_render_alerts", HELD_SQL + """, ch(rule, channel) AS (VALUES ('hot_view','slack'),
  ('hot_view','email'), ('cold_click','slack'), ('flat_error','email'), ('flat_error','pagerduty'),
  ('any_error','slack'), ('any_error','pagerduty')),
m AS (SELECT rule, sample_id, channel, severity, CAST(threshold AS VARCHAR) AS th,
  CAST(value AS VARCHAR) AS v, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t
  FROM held JOIN ch USING (rule) WHERE fires)
SELECT rule, sample_id, channel, CASE WHEN channel = 'email' THEN '<div class="' || severity ||
  '"><h2>Pipeline Alert: ' || rule || '</h2><p><strong>Severity:</strong> ' || severity ||
  '</p><p><strong>Threshold:</strong> ' || th || '</p><p><strong>Current Value:</strong> ' || v ||
  '</p><p><strong>Time:</strong> ' || t || '</p></div>'
  ELSE ':warning: Pipeline Alert: ' || rule || chr(10) || '*Severity:* ' || severity || chr(10) ||
  '*Threshold:* ' || th || chr(10) || '*Current Value:* ' || v || chr(10) || '*Time:* ' || t END
  AS message FROM m""")
def s18(spark, d):
    return ep.render_alerts(held(spark, d).filter("fires"), rules(spark))


@query("j10_missing_targets", """SELECT s_name AS target, n_name AS service FROM supplier
JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey NOT IN (
  SELECT l_suppkey FROM lineitem WHERE l_shipdate > TIMESTAMP '2000-01-01' AND l_shipdate <= TIMESTAMP '2000-01-04')""")
def j10(spark, d):
    targets = model.table(spark, d, "supplier").join(
        model.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("s_name").alias("target"), F.col("n_name").alias("service"))
    seen = model.table(spark, d, "lineitem").filter(
        "l_shipdate > timestamp_ntz'2000-01-01' AND l_shipdate <= timestamp_ntz'2000-01-04'"
    ).select(F.col("l_suppkey").alias("s_suppkey"))
    return targets.join(seen, "s_suppkey", "left_anti").select("target", "service")
