"""Cases in which caps, subtraction, NULL keys or tie-breaks once changed results."""

import math

import pytest
from pyspark.sql import functions as F

from opsloom.operators import documents as docs
from opsloom.operators import search as find
from opsloom.operators.ordered import asof, by_time, last_known, previous, runs, running_sum, trailing_sum
from opsloom.operators.rules import cooldown_sent
from opsloom.operators.summary import ewma_half

SECOND = 1_000_000
HOUR = 3600


def trailing(rows, window, inclusive):
    return [sum(v for u, v in rows if t - window * SECOND < u <= t or (inclusive and u == t - window * SECOND))
            for t, _ in rows]


def test_a_huge_amount_leaves_no_trace_behind(spark):
    rows = [(i, i * SECOND, 1e17 if i == 3 else 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, us long, v double")
    out = {r.id: r.s for r in trailing_sum(df, [], "us", {"s": F.col("v")}, 10, inclusive=False).collect()}
    assert [out[i] for i in range(13, 100)] == [10.0] * 87


def test_infinity_leaves_the_window(spark):
    rows = [(i, i * SECOND, math.inf if i == 3 else 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, us long, v double")
    out = {r.id: r.s for r in trailing_sum(df, [], "us", {"s": F.col("v")}, 10, inclusive=False).collect()}
    assert out[12] == math.inf and out[13] == 10.0 and out[39] == 10.0


@pytest.mark.parametrize("window,seconds", [(7, 3600), (60, 20), (61, 7), (50, 50)])
@pytest.mark.parametrize("inclusive", [True, False])
def test_trailing_sums_at_any_block_size(spark, window, seconds, inclusive):
    rows, u = [], -90 * SECOND
    for i in range(150):
        u += (i * 37 % 9) * SECOND
        rows.append((u, i * 13 % 17))
    df = spark.createDataFrame([(None, i, u, v) for i, (u, v) in enumerate(rows)], "k string, id long, us long, v long")
    got = trailing_sum(df, ["k"], "us", {"s": F.col("v")}, window, inclusive, seconds)
    assert [r.s for r in got.orderBy("id").collect()] == trailing(rows, window, inclusive)


def test_null_keys_keep_their_carry_over_slices(spark):
    rows = [(k, i, i * HOUR * SECOND // 2, float(i)) for k in (None, "", "a") for i in range(8)]
    df = spark.createDataFrame(rows, "k string, id long, us long, v double")
    order, cut = ["us", "id"], by_time("us")

    def column(out, name):
        found = {}
        for r in out.orderBy("id").collect():
            found.setdefault(r.k, []).append(r[name])
        assert set(found) == {None, "", "a"}
        one = found["a"]
        assert all(v == one for v in found.values())
        return one

    assert column(previous(df, ["k"], order, {"p": F.col("v")}, cut), "p") == [None, *map(float, range(7))]
    assert column(running_sum(df, ["k"], order, {"s": F.col("v")}, cut), "s") == [sum(range(i + 1)) for i in range(8)]
    some = F.when(F.col("v") < 2, F.col("v"))
    assert column(last_known(df, ["k"], order, {"l": some}, cut), "l") == [0.0] + [1.0] * 7
    flagged = df.withColumn("f", F.col("v") >= 1)
    assert column(runs(flagged, ["k"], order, "f", "us", cut), "run_start") == [None] + [HOUR * SECOND // 2] * 7
    probes = df.select("k", "id", (F.col("us") + 5 * HOUR * SECOND).alias("us"))
    found = asof(probes, df, ["k"], "us", ["v"], "id").withColumn("found", F.col("found.v"))
    assert column(found, "found") == [7.0] * 8
    sent = {}
    for r in cooldown_sent(df, ["k"], HOUR).collect():
        sent.setdefault(r.k, []).append(r.us)
    assert set(sent) == {None, "", "a"} and len({tuple(sorted(v)) for v in sent.values()}) == 1


@pytest.mark.parametrize("slice_s", [1, 7, 40, 10_000])
def test_cooldown_as_a_plain_walk_at_any_slice(spark, slice_s):
    times = sorted({(i * 7919) % 997 for i in range(300)})
    want, last = [], None
    for t in times:
        if last is None or t - last > 10:
            want.append(t * SECOND)
            last = t
    df = spark.createDataFrame([("r", t * SECOND, t) for t in times], "rule string, us long, sample_id long")
    assert sorted(r.us for r in cooldown_sent(df, ["rule"], 10, slice_s).collect()) == want


def test_half_weight_average_over_many_samples(spark):
    values = [float(i % 11) for i in range(5000)]
    avg = values[0]
    for v in values[1:]:
        avg = (avg + v) / 2
    df = spark.createDataFrame([("a", i, i * 60 * SECOND, v) for i, v in enumerate(values)]
                               + [("b", i, i * 60 * SECOND, math.inf if i == 5 else v) for i, v in enumerate(values)],
                               "name string, sample_id long, us long, value double")
    got = {r.name: r.ewma_half for r in ewma_half(df).collect()}
    assert got["a"] == pytest.approx(avg) and got["b"] == math.inf


def test_search_has_no_cap_and_pages_past_any_end(spark):
    table = spark.range(1500).select("id", F.lit("red apple").alias("title"), F.col("id").alias("size"))
    hits = find.search(table, "apple")
    assert hits.count() == 1500
    page = find.search(table, "apple", sort=["-size"], offset=1400, limit=500).collect()
    assert [r.size for r in page] == list(range(99, -1, -1))
    assert find.search(table, "apple", offset=1500, limit=5).collect() == []
    assert find.search(table, "apple", cap=1000).count() == 1000
    assert find.search(table, "apple", cap=1000, offset=1200, limit=5).collect() == []
    ranked = find.numbered(hits, ["typos", "id"], ["typos"]).orderBy("rank").collect()
    assert [(r.rank, r.id) for r in ranked] == [(i + 1, i) for i in range(1500)]


def test_html_behind_marks_and_long_comments(spark):
    starts = ["<html>", "﻿<!DOCTYPE html>", "<!-- " + "x" * 500 + " -->\n <HTML>",
              "<?xml version='1.0'?>\n<!doctype   html>", "plain <html>", "", "<htm"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(starts)], "id int, t string")
    got = df.select("id", docs.mime_of(F.col("t").cast("binary")).alias("m")).orderBy("id").collect()
    assert [r.m for r in got] == ["text/html"] * 4 + ["text/plain"] * 3


def test_prompts_carry_whole_texts(spark):
    text = "é" * 20_001
    df = spark.createDataFrame([(1, text), (2, "short"), (3, "")], "file_id long, text string")
    rows = docs.prompts(df).where("task = 'title'").orderBy("file_id", "part").collect()
    head = docs.PROMPTS["title"][0]
    assert [r.file_id for r in rows] == [1, 1, 1, 2]
    assert "".join(r.prompt.removeprefix(head) for r in rows[:3]) == text
    assert docs.prompts(df, heads=True).where("task = 'title' AND file_id = 1").first().prompt == head + text[:1000] + "..."


def test_late_rows_do_not_reach_stateful_rules(spark, tmp_path):
    from opsloom.model import as_samples
    from opsloom.streaming import jobs
    day = 86_400
    files = [[(1, 20 * day, 1.0), (2, 20 * day + 60, 5.0)], [(3, 40 * day, 2.0)],
             [(4, 21 * day, 100.0), (5, 40 * day + 60, 8.0)]]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    for n, rows in enumerate(files):
        (spark.createDataFrame([(i, t, 1, "m", v, "{}") for i, t, v in rows],
                               "event_id long, s long, user_id long, event_type string, value double, props string")
         .select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type", "value", "props")
         .coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={n}")))
    source = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .parquet(*[str(tmp_path / "in/part=*")]))
    late = jobs.with_lateness(as_samples(source))
    out = jobs.drain(jobs.stream_rate(late, ["name"], 1e-9, 300), "late-rate")
    assert sorted(r.sample_id for r in out.collect()) == [1, 2, 3, 5]


def test_a_round_appended_twice_adds_nothing(spark, tmp_path):
    from opsloom.sources.samples import append_samples
    path = str(tmp_path / "store")
    rounds = spark.sql("""SELECT 'c' AS collector, map('m', named_struct('value', 1.5D, 'labels', map('k', 'v'),
        'timestamp', '2024-01-01T00:00:00')) AS metrics""")
    if set(rounds.columns) - {"collector", "metrics"}:
        pytest.skip("other round form")
    append_samples(rounds, path)
    append_samples(rounds, path)
    assert spark.read.parquet(path).count() == 1
