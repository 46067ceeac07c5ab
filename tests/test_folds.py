"""Ordered operators against plain sequential models, across slice borders, gaps and ties."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from opsloom.operators import episodes, ordered, panels, rules, summary

S = 1_000_000


def series(seed, n=300, keys=("a", "b"), span_h=9, coarse=60):
    """Random samples over several slices with an empty stretch and shared times."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        t = rnd.randrange(0, span_h * 3600, coarse)
        if 3 * 3600 <= t < 5 * 3600:
            t = 5 * 3600
        rows.append((i, rnd.choice(keys), t * S, float(rnd.randrange(0, 10))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "sample_id LONG, name STRING, us LONG, value DOUBLE")


def by_key(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out[r[1]].append(r)
    return out


def collected(df, *cols):
    return {r["sample_id"]: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_running_sum_index_previous(spark, seed):
    rows = series(seed)
    df = frame(spark, rows)
    cut = ordered.by_time("us")
    total = collected(ordered.running_sum(df, ["name"], ["us", "sample_id"], {"s": F.col("value")},
                                          cut), "s")
    index = collected(ordered.row_index(df, ["name"], ["us", "sample_id"], cut), "idx")
    prev = collected(ordered.previous(df, ["name"], ["us", "sample_id"], {"p": F.col("value")},
                                      cut), "p")
    for mine in by_key(rows).values():
        acc, last = 0.0, None
        for i, (sid, _, _, v) in enumerate(mine):
            acc += v
            assert (total[sid], index[sid], prev[sid]) == ((acc,), (i,), (last,))
            last = v


@pytest.mark.parametrize("seed", range(3))
def test_last_known_both_directions(spark, seed):
    rows = series(seed)
    df = frame(spark, rows)
    high = F.when(F.col("value") > 7, F.col("value"))
    for newest in (False, True):
        got = collected(ordered.last_known(df, ["name"], ["us", "sample_id"], {"k": high},
                                           ordered.by_time("us"), newest_first=newest), "k")
        for mine in by_key(rows).values():
            known = None
            for sid, _, _, v in (reversed(mine) if newest else mine):
                known = v if v > 7 else known
                assert got[sid] == (known,)


@pytest.mark.parametrize("inclusive", [True, False])
def test_trailing_sum(spark, inclusive):
    rows = series(5)
    got = collected(ordered.trailing_sum(frame(spark, rows), ["name"], "us",
                                         {"n": F.lit(1), "s": F.col("value").cast("long")}, 5400,
                                         inclusive), "n", "s")
    for mine in by_key(rows).values():
        for sid, _, t, _ in mine:
            low = t - 5400 * S
            inside = [r for r in mine if r[2] <= t and (r[2] >= low if inclusive else r[2] > low)]
            assert got[sid] == (len(inside), sum(r[3] for r in inside))


@pytest.mark.parametrize("duration", [0, 600, 5400])
@pytest.mark.parametrize("seed", range(4))
def test_threshold_hold(spark, duration, seed):
    rows = series(seed, n=200)
    df = frame(spark, rows).withColumn("violated", F.col("value") > 2)
    got = collected(rules.hold(df, ["name"], duration_s=F.lit(duration)), "run_start", "fires")
    for mine in by_key(rows).values():
        start = None
        for sid, _, t, v in mine:
            start = (t if start is None else start) if v > 2 else None
            assert got[sid] == (start, start is not None and t - start >= duration * S)


@pytest.mark.parametrize("cooldown,slice_s", [(300, 600), (1800, 3600), (7200, 7200), (60, 86400)])
@pytest.mark.parametrize("seed", range(2))
def test_cooldown_sent(spark, cooldown, slice_s, seed):
    rows = series(seed, n=250, coarse=45)
    got = sorted((r["name"], r["us"]) for r in rules.cooldown_sent(
        frame(spark, rows), ["name"], cooldown, slice_s).collect())
    want = []
    for key, mine in by_key(rows).items():
        sent = None
        for _, _, t, _ in mine:
            if sent is None or t - sent > cooldown * S:
                sent = t
                want.append((key, t))
    assert got == sorted(want)


def test_rate_rule(spark):
    rows = series(8)
    got = collected(rules.rate_rule(frame(spark, rows), ["name"], 0.001, 3600), "rate")
    for mine in by_key(rows).values():
        for sid, _, t, v in mine:
            first = min((r for r in mine if t - 3600 * S <= r[2] <= t), key=lambda r: (r[2], r[0]))
            want = None if first[2] == t else (v - first[3]) / ((t - first[2]) / S)
            assert got[sid][0] == (pytest.approx(want) if want is not None else None)


def test_ewma_and_trend_match_folds(spark):
    rows = series(2, n=120)
    df = frame(spark, rows)
    ewma = {r["name"]: r["ewma_half"] for r in summary.ewma_half(df).collect()}
    out = {r["name"]: r for r in summary.series_summary(df, ["name"]).collect()}
    for key, mine in by_key(rows).items():
        values = [r[3] for r in mine]
        avg = values[0]
        for v in values[1:]:
            avg = (avg + v) / 2
        n = len(values)
        mx, my = (n - 1) / 2, sum(values) / n
        slope = (sum((i - mx) * (v - my) for i, v in enumerate(values))
                 / sum((i - mx) ** 2 for i in range(n)))
        assert ewma[key] == pytest.approx(avg)
        assert out[key]["slope"] == pytest.approx(slope)
        assert out[key]["current"] == values[-1] and out[key]["n"] == n


def test_ewma_deep_series_equals_fold(spark):
    df = spark.range(5000).select(F.col("id").alias("sample_id"), F.lit("x").alias("name"),
                                  (F.col("id") * S).alias("us"),
                                  (F.col("id") % 17).cast("double").alias("value"))
    avg = 0.0
    for i in range(1, 5000):
        avg = (avg + i % 17) / 2
    assert summary.ewma_half(df).first()["ewma_half"] == pytest.approx(avg, abs=1e-12)


def test_episodes_lifecycle(spark):
    fires = spark.createDataFrame([("r", 10 * S, 1, 5.0), ("r", 20 * S, 2, 7.0), ("r", 9000 * S, 4, 6.0)],
                                  "name STRING, us LONG, sample_id LONG, value DOUBLE")
    ends = spark.createDataFrame([("r", 5 * S, 0), ("r", 30 * S, 3)],
                                 "name STRING, us LONG, sample_id LONG")
    got = sorted((r["opened_us"], r["fires"], r["status"], r["duration_s"], r["final_value"])
                 for r in episodes.alert_episodes(fires, ends, ["name"]).collect())
    assert got == [(10 * S, 2, "resolved", 20.0, 7.0), (9000 * S, 1, "active", None, 6.0)]


def test_counter_resets(spark):
    rows = [(i, "c", i * 60 * S, v) for i, v in enumerate([10.0, 20.0, 5.0, 15.0])]
    df = frame(spark, rows).withColumnRenamed("value", "counter")
    total = panels.counter_deltas(df, ["name"]).agg(F.sum("delta")).first()[0]
    assert total == 10 + 5 + 10


def test_keep_newest_hot_group(spark):
    df = spark.range(1000).select(F.col("id").alias("sample_id"), F.lit("hot").alias("name"),
                                  F.col("id").alias("us"))
    got = ordered.keep_newest(df, ["name"], ["us", "sample_id"], 7, "sample_id").collect()
    assert sorted(r["us"] for r in got) == list(range(993, 1000))


def test_asof_exact_time_and_before_first(spark):
    samples = spark.createDataFrame([("m", 100 * S, 1, 1.0), ("m", 8000 * S, 2, 2.0)],
                                    "name STRING, us LONG, sample_id LONG, value DOUBLE")
    probes = spark.createDataFrame([("m", 99 * S), ("m", 100 * S), ("m", 7999 * S), ("m", 90000 * S)],
                                   "name STRING, us LONG")
    got = {r["us"]: r["found"] and r["found"]["value"] for r in ordered.asof(
        probes, samples, ["name"], "us", ["value"], "sample_id").collect()}
    assert got == {99 * S: None, 100 * S: 1.0, 7999 * S: 1.0, 90000 * S: 2.0}


def test_no_frame_is_summed_anew_for_every_row(spark):
    """Frames that end with their partition cost the square of its rows."""
    from opsloom.operators.rules import pattern_rule
    log = spark.createDataFrame([(i, "a", i * 1_000_000, str(i)) for i in range(50)],
                                "sample_id LONG, name STRING, us LONG, line STRING")
    for hold in (0, 20):
        out = pattern_rule(log, ["name"], "line", "^[1-5]", 2, 30, duration_s=hold)
        assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()
