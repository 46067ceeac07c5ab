"""Written tables, snapshots, and streams over several files with a restart."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opsloom import model
from opsloom.operators import rules as rl
from opsloom.plans.alerting import rules
from opsloom.session import fresh_dir
from opsloom.sources import files, snapshots
from opsloom.streaming import jobs


def test_sidecars(spark, tmp_path):
    for name in ("a.pdf", "b.pdf"):
        (tmp_path / name).write_bytes(b"%PDF-1.7")
        (tmp_path / f"{name}.metadata").write_text(json.dumps({"mime_type": name}, indent=2))
    side = files.read_sidecars(spark, str(tmp_path), "mime_type STRING")
    assert sorted((os.path.basename(r["path"]), r["mime_type"]) for r in side.collect()) == [
        ("a.pdf", "a.pdf"), ("b.pdf", "b.pdf")]
    found = files.scan_files(spark, str(tmp_path), "*.pdf", content=True)
    assert sorted((r["file_name"], r["extension"], r["file_size"]) for r in found.collect()) == [
        ("a.pdf", "pdf", 8), ("b.pdf", "pdf", 8)]


def test_snapshot_rotation_and_damage(spark):
    root = fresh_dir(spark, "snap")
    df = spark.range(5)
    for day in range(1, 10):
        snapshots.snapshot(df, root, "daily", f"2024-01-{day:02d} 03:00:00")
    gone = [r["stamp"] for r in snapshots.expired(spark, root).collect()]
    assert sorted(gone) == ["20240101_030000", "20240102_030000"]
    newest = snapshots.list_snapshots(spark, root, "daily").first()
    assert newest["stamp"] == "20240109_030000" and newest["row_count"] == 5
    with pytest.raises(ValueError):
        snapshots.restore(spark, root, "daily", "20230101_000000", df, f"{root}/t", "2024-02-01")


def split_events(spark, sf_dir, parts=3):
    """The events in time order as several files, and the folder they lie in."""
    path = fresh_dir(spark, "events")
    e = model.table(spark, sf_dir, "events", model.EVENTS)
    bounds = e.select(F.percentile_approx("event_id", [0.33, 0.66])).first()[0]
    edges = [-1, *bounds, 1 << 60]
    return path, [e.filter((F.col("event_id") > a) & (F.col("event_id") <= b)).coalesce(1)
                  for a, b in zip(edges, edges[1:])]


def test_threshold_stream_with_restart_equals_batch(spark, sf_dir):
    path, parts = split_events(spark, sf_dir)
    out, check = fresh_dir(spark, "out"), fresh_dir(spark, "check")
    for part in parts:  # each pass starts a new query on the same checkpoint
        part.write.mode("append").parquet(path)
        stream = model.as_samples(jobs.file_stream(spark, path, model.EVENTS))
        jobs.drain(jobs.stream_threshold(stream, rules(spark)), "t", out=out, checkpoint=check)
    cols = ["rule", "sample_id", "violated", "run_start", "fires"]
    streamed = sorted(map(tuple, spark.read.parquet(out).select(*cols).collect()))
    batch = rl.threshold_rule(model.samples(spark, sf_dir), rules(spark)).select(*cols)
    assert streamed == sorted(map(tuple, batch.collect()))


def test_pattern_and_rate_streams_over_files(spark, sf_dir):
    path, parts = split_events(spark, sf_dir)
    outs = [(fresh_dir(spark, "out"), fresh_dir(spark, "check")) for _ in range(2)]
    for part in parts:
        part.write.mode("append").parquet(path)
        stream = model.as_samples(jobs.file_stream(spark, path, model.EVENTS))
        jobs.drain(jobs.stream_pattern(stream, ["name"], F.col("labels")["k"].rlike("^[1-5]"), 2,
                                       86400), "p", out=outs[0][0], checkpoint=outs[0][1])
        jobs.drain(jobs.stream_rate(stream, ["name"], 0.001, 86400), "r", out=outs[1][0],
                   checkpoint=outs[1][1])
    s = model.samples(spark, sf_dir)
    log = s.select("sample_id", "name", "us", F.col("labels")["k"].alias("line"))
    batch = rl.pattern_rule(log, ["name"], "line", "^[1-5]", 2, 86400)
    cols = ["sample_id", "matches", "fires"]
    assert sorted(map(tuple, spark.read.parquet(outs[0][0]).select(*cols).collect())) == sorted(
        map(tuple, batch.select(*cols).collect()))
    rate = rl.rate_rule(s, ["name"], 0.001, 86400)
    cols = ["sample_id", F.round("rate", 9), "fires"]
    assert sorted(map(str, spark.read.parquet(outs[1][0]).select(*cols).collect())) == sorted(
        map(str, rate.select(*cols).collect()))


def test_episode_stream_over_files(spark, sf_dir):
    path, parts = split_events(spark, sf_dir)
    out, check = fresh_dir(spark, "out"), fresh_dir(spark, "check")
    flagged = lambda s: s.filter("name IN ('error', 'signup') AND value > 40").select(
        F.lit("r").alias("rule"), "us", "sample_id",
        (F.col("name") == "signup").cast("int").alias("resolve"), "value",
        F.lit(43200).alias("cooldown_s"))
    for part in parts:
        part.write.mode("append").parquet(path)
        stream = model.as_samples(jobs.file_stream(spark, path, model.EVENTS))
        jobs.drain(jobs.stream_episodes(flagged(stream), ["rule"]), "e", out=out, checkpoint=check)
    got = spark.read.parquet(out)
    fires = flagged(model.samples(spark, sf_dir)).filter("resolve = 0")
    sent = rl.cooldown_sent(fires, ["rule"], 43200)
    assert sorted(r["us"] for r in got.filter("kind = 'notify'").collect()) == sorted(
        r["us"] for r in sent.collect())


def test_alert_sink_chain(spark, sf_dir):
    path, parts = split_events(spark, sf_dir)
    root, check = fresh_dir(spark, "alerts"), fresh_dir(spark, "check")
    for part in parts:
        part.write.mode("append").parquet(path)
        stream = model.as_samples(jobs.file_stream(spark, path, model.EVENTS))
        fires = jobs.stream_threshold(stream, rules(spark)).filter("fires")
        jobs.write_alerts(fires, rules(spark), root, check).awaitTermination()
    fired = rl.threshold_rule(model.samples(spark, sf_dir), rules(spark)).filter("fires")
    want = {r["rule"]: (r["a"], r["b"]) for r in fired.groupBy("rule").agg(
        F.min("us").alias("a"), F.max("us").alias("b")).collect()}
    got = {r["rule"]: (r["a"], r["b"]) for r in jobs.newest_state(spark, root).select(
        "rule", F.unix_micros("created_at").alias("a"), F.unix_micros("updated_at").alias("b")).collect()}
    assert got == want


def test_unmatched_start_comes_out(spark):
    path = fresh_dir(spark, "pairs")
    rows = [("a", "s", "2024-01-01 00:00:00"), ("a", "d", "2024-01-01 00:10:00"),
            ("b", "s", "2024-01-01 00:00:00"), ("c", "s", "2024-01-02 00:00:00"),
            ("c", "d", "2024-01-02 00:01:00")]
    spark.createDataFrame(rows, "k STRING, kind STRING, t STRING").select(
        "k", "kind", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(path)
    src = jobs.file_stream(spark, path, "k STRING, kind STRING, ts TIMESTAMP")
    out = jobs.drain(jobs.stream_pair(src.filter("kind = 's'"), src.filter("kind = 'd'"), "k",
                                      "1 HOURS"), "pair").collect()
    assert {r["k"]: r["done_us"] is not None for r in out} == {"a": True, "b": False, "c": True}


def state_rows(spark, checkpoint):
    return (spark.read.format("statestore").option("stateVarName", "series").load(checkpoint)).count()


def three_files(spark):
    """Samples of a busy series, of one that stops, and of one whose last run is open when it stops."""
    hour = 3_600_000_000
    rows = [("busy", h) for h in range(0, 60)] + [("stops", h) for h in range(0, 6)] + [("open", h) for h in range(0, 9)]
    rows = [(i, n, (h + 24) * hour + i, 9.0 if (n == "open" and h > 5) or (n == "busy" and h % 7 < 3) else 1.0)
            for i, (n, h) in enumerate(rows)]
    for low, high in ((0, 20), (20, 40), (40, 60)):
        yield spark.createDataFrame([r for r in rows if low <= r[2] // hour - 24 < high],
                                    "sample_id LONG, name STRING, us LONG, value DOUBLE").coalesce(1)


SMALL = "sample_id LONG, name STRING, us LONG, value DOUBLE"


@pytest.mark.parametrize("idle", [None, 12 * 3600])
def test_idle_series_leave_no_state(spark, idle):
    """Three files, each read by a query that starts anew on the same checkpoint."""
    path, out, check, out2, check2 = (fresh_dir(spark, k) for k in ("in", "o", "c", "o2", "c2"))
    rule = spark.createDataFrame([("r", n, "greater", 5.0, 3600, 7200) for n in ("busy", "stops", "open")],
                                 "rule STRING, metric STRING, comparison STRING, threshold DOUBLE, duration_s INT, cooldown_s INT")
    for part in three_files(spark):
        part.write.mode("append").parquet(path)
        s = (jobs.file_stream(spark, path, SMALL).withColumn("ts", F.timestamp_micros("us"))
             .withWatermark("ts", "1 hour"))
        jobs.drain(jobs.stream_threshold(s, rule, ["name"], idle_s=idle), "t", out=out, checkpoint=check)
        marks = s.filter("name <> 'stops'").select("name", "ts", "us", "sample_id", (F.col("value") < 5).alias("resolve"),
                                                   "value", F.lit(7200).alias("cooldown_s"))
        jobs.drain(jobs.stream_episodes(marks, ["name"], idle_s=idle), "e", out=out2, checkpoint=check2)
    held = spark.read.parquet(out)
    assert held.count() == 75 and held.filter("name = 'open' AND fires").count() == 2
    episodes = [tuple(r) for r in spark.read.parquet(out2).filter("kind = 'expired'")
                .select("name", "us", "fires", "peak_value").collect()]
    last = 32 * 3_600_000_000 + 60 + 6 + 8
    assert episodes == ([("open", last + idle * 1_000_000, 3, 9.0)] if idle else [])
    assert state_rows(spark, check) == (1 if idle else 3) and state_rows(spark, check2) == (1 if idle else 2)


def test_idle_series_need_a_watermark(spark):
    path = fresh_dir(spark, "in")
    spark.createDataFrame([(1, "a", 1, 1.0)], SMALL).write.parquet(path)
    s = jobs.file_stream(spark, path, SMALL)
    with pytest.raises(ValueError):
        jobs.stream_threshold(s, rules(spark), idle_s=60)


def test_late_rows_are_kept_and_counted(spark):
    root, check, path = (fresh_dir(spark, k) for k in ("r", "c", "in"))
    day = 86_400_000_000
    parts = [[(1, "a", 10 * day, 1.0), (2, "a", 2 * day, 1.0), (3, None, 9 * day, 1.0)],
             [(4, "a", 3 * day - 1, 1.0), (5, "a", 3 * day, 1.0), (6, "a", 12 * day, 1.0), (7, None, None, 1.0)],
             [(8, "a", 4 * day, 1.0), (9, "a", 5 * day, 1.0)]]
    for part in parts:
        spark.createDataFrame(part, SMALL).coalesce(1).write.mode("append").parquet(path)
        jobs.stream_on_time(jobs.file_stream(spark, path, SMALL), root, check, 7 * 86400).awaitTermination()
    rows = {(r.batch_id, r.sample_id): r.reason for r in jobs.batches_of(spark, root, "rows").collect()}
    assert rows == {(0, 1): None, (0, 2): None, (0, 3): "no name", (1, 4): "late", (1, 5): None, (1, 6): None,
                    (1, 7): "no name", (2, 8): "late", (2, 9): None}
    counts = {(r.batch_id, r.reason): (r.n, r.first_us) for r in jobs.batches_of(spark, root, "counts").collect()}
    assert counts[2, "late"] == (1, 4 * day) and counts[1, None] == (2, 3 * day) and sum(n for n, _ in counts.values()) == 9


def test_series_of_a_batch_are_held_as_numbers():
    """Of the rows of a series in one batch only three numbers each are held, not frames with their names."""
    import tracemalloc

    from opsloom.streaming.jobs import _ordered

    def frames():
        for at in range(0, 200_000, 10_000):
            us = np.arange(at + 10_000, at, -1)
            yield pd.DataFrame({"name": [f"series {i}" for i in range(10_000)], "sample_id": us, "us": us, "value": us / 2})

    tracemalloc.start()
    us, ids, values = _ordered(frames(), "value", 11)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert us[0] == ids[0] == 11 and len(us) == 199_990 and (np.diff(us) > 0).all() and values[-1] == 100_000
    assert peak < 200_000 * 100
