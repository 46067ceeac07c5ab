"""Hand-made edge frames."""

import datetime as dt
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opsloom.functions import parse
from opsloom.operators import (documents, graph, joins, panels, quality, rules, search, similar, vectors,
                               state, summary, training)
from opsloom.operators import select as sel
from opsloom.session import small_table

S = 1_000_000
SAMPLE = "sample_id LONG, name STRING, us LONG, value DOUBLE"


def test_empty_health_is_zero_and_stable(spark):
    df = spark.createDataFrame([], SAMPLE + ", ts TIMESTAMP")
    row = summary.health(df, "cpu").first()
    assert (row["n"], row["current"], row["avg"], row["max"], row["trend"]) == (0, 0, 0, 0, "stable")


@pytest.mark.parametrize("slope,want", [(0, "stable"), (0.0625, "stable"), (0.125, "increasing"),
                                        (-0.125, "decreasing")])
def test_trend_limit(spark, slope, want):
    rows = [(i, "m", i * 1800 * S, float(5 + slope * i)) for i in range(9)]
    assert summary.series_summary(spark.createDataFrame(rows, SAMPLE), ["name"]).first()[
        "trend"] == want


def test_one_row_and_order_do_not_matter(spark):
    one = summary.series_summary(spark.createDataFrame([(1, "m", 5, 3.0)], SAMPLE), ["name"]).first()
    assert (one["trend"], one["current"], one["slope"]) == ("stable", 3.0, None)
    rows = [(i, "m", i * S, float(i % 4)) for i in range(20)]
    up = summary.series_summary(spark.createDataFrame(rows, SAMPLE), ["name"]).collect()
    down = summary.series_summary(spark.createDataFrame(rows[::-1], SAMPLE), ["name"]).collect()
    assert up == down


def test_hold_fires_at_exact_duration_and_restarts(spark):
    rows = [(0, "m", 0, 9.0), (1, "m", 100 * S, 9.0), (2, "m", 299 * S, 9.0), (3, "m", 300 * S, 9.0),
            (4, "m", 301 * S, 0.0), (5, "m", 400 * S, 9.0)]
    rule = small_table(spark, "rule STRING, metric STRING, comparison STRING, threshold DOUBLE, "
                       "duration_s INT", [("r", "m", "greater", 5.0, 300)])
    out = rules.threshold_rule(spark.createDataFrame(rows, SAMPLE), rule)
    assert [r["sample_id"] for r in out.filter("fires").collect()] == [3]


def test_comparisons_and_text(spark):
    df = spark.createDataFrame([("5", "equal"), ("5.00005", "equal"), ("5.0002", "equal"),
                                ("abc", "greater"), (None, "less"), ("9", "between"),
                                ("9", "greater")], "v STRING, c STRING")
    got = [r[0] for r in df.select(rules.violates(F.col("v"), F.col("c"), F.lit(5.0))).collect()]
    assert got == [True, True, False, False, False, False, True]


def test_cooldown_variants(spark):
    rows = [(i, "m", t * S, 1.0) for i, t in enumerate([0, 200, 301, 302, 700])]
    df = spark.createDataFrame(rows, SAMPLE)
    gap = rules.cooldown_gap(df, ["name"], 300).filter("notify").collect()
    assert sorted(r["us"] // S for r in gap) == [0, 700]
    sent = rules.cooldown_sent(df, ["name"], 300).collect()
    assert sorted(r["us"] // S for r in sent) == [0, 301, 700]


def test_rate_window_edges(spark):
    rows = [(0, "m", 0, 0.0), (1, "m", 300 * S, 30.0), (2, "m", 300 * S, 60.0), (3, "n", 0, 1.0)]
    out = {r["sample_id"]: r["rate"] for r in rules.rate_rule(
        spark.createDataFrame(rows, SAMPLE), ["name"], 0.05).collect()}
    assert out == {0: None, 1: 0.1, 2: 0.2, 3: None}


def test_relative_change_from_zero(spark):
    rows = [(0, "m", 0, 0.0), (1, "m", S, 5.0), (2, "m", 2 * S, 10.0)]
    out = {r["sample_id"]: (r["change"], r["fires"]) for r in rules.relative_change(
        spark.createDataFrame(rows, SAMPLE), ["name"], 0.5).collect()}
    assert out == {0: (None, False), 1: (None, False), 2: (1.0, True)}


def test_pattern_counts_edge_and_needs_a_match(spark):
    rows = [(0, "l", 0, "ERR a"), (1, "l", 100 * S, "ERR b"), (2, "l", 300 * S, "ERR c"),
            (3, "l", 300 * S + 1, "ok"), (4, "l", 301 * S, "ERR d")]
    df = spark.createDataFrame(rows, "sample_id LONG, name STRING, us LONG, line STRING")
    out = {r["sample_id"]: (r["matches"], r["fires"]) for r in rules.pattern_rule(
        df, ["name"], "line", "^ERR", 3).collect()}
    assert out[2] == (3, True) and out[3] == (2, False) and out[4] == (3, True)


def test_composite_edge_cases(spark):
    cond = lambda m, t: {"type": "threshold", "metric": m, "comparison": "greater", "threshold": t}
    schema = ("rule STRING, operator STRING, duration_s INT, conditions "
              "ARRAY<STRUCT<type:STRING,metric:STRING,comparison:STRING,threshold:DOUBLE>>")
    defs = small_table(spark, schema, [("skip", "AND", 0, [cond("m", 1.0), cond("gone", 1.0)]),
                                       ("odd", "XOR", 0, [cond("m", 1.0)]), ("none", "AND", 0, [])])
    df = spark.createDataFrame([(0, "m", 0, 5.0)], SAMPLE)
    out = {r["rule"]: r["violated"] for r in rules.composite_eval(
        rules.composite_values(df, defs)).collect()}
    assert out == {"skip": True, "odd": False}


def test_quantile_from_buckets(spark):
    h = spark.createDataFrame([("a", "1", 2), ("a", "2", 6), ("a", "+Inf", 8), ("z", "1", 0),
                               ("z", "+Inf", 0)], "name STRING, le STRING, cum_count LONG")
    def q(p):
        return {r["name"]: r["quantile"] for r in panels.histogram_quantile(h, p, ["name"]).collect()}
    assert q(0.5) == {"a": 1.5, "z": None} and q(0.95)["a"] == 2.0


def test_error_ratio_gap(spark):
    schema = "inst STRING, step_us LONG, rate DOUBLE"
    bad = spark.createDataFrame([("x", 0, 2.0), ("y", 0, 4.0)], schema)
    good = spark.createDataFrame([("x", 0, 6.0)], schema)
    assert panels.error_ratio(bad, good, ["inst"]).first()["error_ratio"] == 6.0 / 8.0


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([(i, "m", 0, float(i)) for i in range(10)], SAMPLE)
    cells = {r["le"]: r["cum_count"] for r in panels.histogram(df, [2, 5], ["name"]).collect()}
    assert cells == {"2": 3, "5": 6, "+Inf": 10}


def test_routing(spark):
    mb = 1024 * 1024
    df = spark.createDataFrame([("text/plain", "high", 1), ("application/zip", "low", 101 * mb),
                                ("application/zip", "low", 100 * mb), ("video/mp4", "low", 1),
                                ("application/zip", "high", 101 * mb)], "m STRING, p STRING, s LONG")
    got = [r[0] for r in df.select(sel.route_queue(F.col("m"), F.col("p"), F.col("s"))).collect()]
    assert got == ["embeddings_staging", "raw_batch", "raw_normal", "raw_batch", "raw_priority"]


def test_dewey(spark):
    df = spark.createDataFrame([("It is 025.04.",), ("no",), ("12",), ("999.123",), (None,)], "t STRING")
    got = [r[0] for r in df.select(parse.dewey(F.col("t"))).collect()]
    assert got == ["025.04", "000.00", "000.00", "999.123", "000.00"]
    flagged = quality.check_dewey(df.select(F.lit(1).alias("k"), parse.dewey(F.col("t"))
                                            .alias("dewey_decimal")), "k").collect()
    assert [r["dewey_decimal"] for r in flagged] == ["999.123"]
    files = spark.createDataFrame([(1, "025.04"), (2, "999.1"), (3, "x")], "file_id INT, dewey_decimal STRING")
    cats = {r["file_id"]: r["dewey_category"] for r in joins.dewey_category(
        files, joins.dewey_ranges(spark)).collect()}
    assert cats[1].startswith("Computer") and cats[2].startswith("History") and cats[3] == ""


def test_category_and_entity_responses(spark):
    df = spark.createDataFrame([("legal:0.8",), ("legal",), ("a:b:c",), ("x:high",)], "t STRING")
    got = [tuple(r[0]) for r in df.select(parse.category_confidence(F.col("t"))).collect()]
    assert got == [("legal", 0.8), (None, 0.0), (None, 0.0), (None, 0.0)]
    text = spark.createDataFrame([('x [{"name":"a","type":"t"}] y',), ("[{bad",), ("none",)], "t STRING")
    assert [len(r[0]) for r in text.select(parse.entities(F.col("t"))).collect()] == [1, 0, 0]


def test_chunks(spark):
    df = spark.createDataFrame([(0, ""), (1, "a" * 8000), (2, "b" * 8001)], "file_id LONG, text STRING")
    out = documents.chunk(df).collect()
    assert sorted((r["file_id"], r["pos"], len(r["chunk"])) for r in out) == [
        (1, 0, 8000), (2, 0, 8000), (2, 1, 1)]


def test_pool_of_opposite_vectors_is_null(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [-1.0, 0.0]), ("b", [3.0, 4.0])],
                               "file_id STRING, embedding ARRAY<DOUBLE>")
    got = {r["file_id"]: r["embedding"] for r in summary.pool_vectors(df).collect()}
    assert got["a"] is None and got["b"] == pytest.approx([0.6, 0.8])


def test_upsert_twice_then_delete(spark):
    schema = "k STRING, created_at TIMESTAMP, updated_at TIMESTAMP, seq LONG, deleted BOOLEAN, v LONG"
    t = [dt.datetime(2024, 1, d) for d in range(1, 6)]
    first = spark.createDataFrame([("a", t[0], t[0], 1, False, 1)], schema)
    again = spark.createDataFrame([("a", t[1], t[1], 2, False, 2)], schema)
    gone = spark.createDataFrame([("a", t[2], t[2], 3, True, 0)], schema)
    back = spark.createDataFrame([("a", t[3], t[3], 4, False, 4)], schema)
    once = state.upsert(first, again, "k")
    row = once.first()
    assert (row["created_at"], row["updated_at"], row["v"]) == (t[0], t[1], 2)
    assert state.upsert(once.select(*first.columns), again, "k").collect() == once.collect()
    assert state.upsert(first.unionByName(again), gone, "k").count() == 0
    assert state.upsert(first.unionByName(gone), back, "k").first()["created_at"] == t[3]


def test_retention_keeps_the_cutoff(spark):
    now = dt.datetime(2024, 2, 1)
    df = spark.createDataFrame([(now - dt.timedelta(days=30),),
                                (now - dt.timedelta(days=30, microseconds=1),)], "ts TIMESTAMP")
    assert state.retain(df, 30, now).count() == 1
    assert tuple(state.retention_count(df, 30, now).first()) == (1, 1)


def test_split_and_batches(spark):
    df = spark.createDataFrame([(i, f"L{i % 3}") for i in range(30)], "id LONG, label STRING")
    split = training.stratified_split(df)
    sizes = {(r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert all(sizes[(f"L{i}", "test")] == 2 and sizes[(f"L{i}", "train")] == 8 for i in range(3))
    assert split.orderBy("id").collect() == training.stratified_split(df).orderBy("id").collect()
    batches = training.assign_batches(split, 2, batch=5)
    assert batches.count() == 30
    assert max(r["n"] for r in batches.groupBy("split", "worker", "batch").agg(
        F.count("*").alias("n")).collect()) == 5


def test_report_totals(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "label STRING, prediction STRING")
    assert training.confusion_matrix(df).agg(F.sum("n")).first()[0] == 4
    rep = {r["class"]: r for r in training.classification_report(df).collect()}
    assert rep["accuracy"]["f1"] == 0.5 and rep["b"]["recall"] == 1.0
    assert rep["c"]["f1"] == 0.0 and rep["a"]["precision"] == 1.0


def test_range_summary_rejects_unknown(spark):
    with pytest.raises(ValueError):
        summary.range_summary(spark.createDataFrame([], "collector STRING, value DOUBLE, ts TIMESTAMP"),
                              "2024-01-01", ["2h"])


def test_knn_blocks_agree(spark):
    rows = [(i, [float((i * 7) % 11), float((i * 5) % 13)]) for i in range(60)]
    v = spark.createDataFrame(rows, "query_id LONG, embedding ARRAY<DOUBLE>")
    base = v.withColumnRenamed("query_id", "base_id")
    one = sorted(map(tuple, vectors.knn(v, base, 3).select("query_id", "base_id", "rank").collect()))
    many = sorted(map(tuple, vectors.knn(v, base, 3, block_bytes=400).select(
        "query_id", "base_id", "rank").collect()))
    brute = []
    for i, a in rows:
        order = sorted((round(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5, 9), j)
                       for j, b in rows if j != i)
        brute += [(i, j, r + 1) for r, (_, j) in enumerate(order[:3])]
    assert one == many == sorted(brute)


@pytest.mark.parametrize("d", [0, 1, 3, 7])
def test_phash_pairs_brute_force(spark, d):
    import random
    rnd = random.Random(d)
    seeds = [rnd.getrandbits(64) for _ in range(8)]
    values = [s ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for s in seeds for _ in range(6)]
    values += [0, 0, (1 << 64) - 1]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "file_id LONG, phash LONG")
    got = sorted(map(tuple, similar.phash_pairs(df, d).collect()))
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    want = [(first[v], i, 0) for i, v in enumerate(values) if first[v] != i]
    names = sorted(first.items(), key=lambda x: x[1])
    want += [(a, b, bin(x ^ y).count("1")) for n, (x, a) in enumerate(names) for y, b in names[n + 1:]
             if bin(x ^ y).count("1") <= d]
    assert got == sorted(want)


@pytest.mark.parametrize("known", [3, 50_000])
def test_tags_are_the_best_of_all_terms(spark, monkeypatch, known):
    monkeypatch.setattr(documents, "KNOWN_TERMS", known)
    draw = random.Random(known)
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in "xyz"]
    texts = [(i, " ".join(draw.choices(words, range(len(words), 0, -1), k=draw.randrange(60)))) for i in range(40)]
    texts += [(41, None), (42, ""), (43, "ab c"), (None, "axe aax"), (None, "aax oxo"), (3, "aax " + "q" * 90), (44, "É éTÉ été")]
    df = spark.createDataFrame(texts, "file_id LONG, text STRING").repartition(4)
    got = sorted(((r.file_id, r["rank"], r.term, r.score) for r in documents.tags(df, 4).collect()), key=str)
    counts = {}
    for i, t in texts:
        for w in (t or "").lower().split():
            if len(w) >= 3:
                counts.setdefault(i, {}).setdefault(w, 0)
                counts[i][w] += 1
    want = []
    for i, c in counts.items():
        scores = sorted((-round(n * math.log((len(texts) + 1) / (sum(w in o for o in counts.values()) + 1)), 9), w)
                        for w, n in c.items())
        want += [(i, rank, w, -s) for rank, (s, w) in enumerate(scores[:4], 1)]
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want, key=str)]
    assert all(abs(x[3] - y[3]) < 1e-8 for x, y in zip(got, sorted(want, key=str)))


def test_only_possible_tags_travel():
    class Known:
        value = pa.table({"term": ["the", "and"], "df": [900, 500]})
    row = pa.RecordBatch.from_pydict({"file_id": [1], "terms": [["the", "and", "new", "one", "q" * 90]], "tf": [[3, 2, 5, 1, 1]]})
    out = pa.Table.from_batches(documents.possible_tags(Known, 1000, 1)([row]))
    assert out["term"].to_pylist() == ["new", "one", "q" * 90]


def test_related_links_copies_and_near_copies(spark):
    base = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    rows = [(0, base), (1, base), (2, base + " extra"), (3, "something else entirely here now")]
    got = {(r["src"], r["dst"]): r["score"] for r in similar.related(
        spark.createDataFrame(rows, "file_id LONG, text STRING")).collect()}
    assert got[(0, 1)] == 1.0 and (0, 2) in got and not any(3 in k for k in got)


def test_search_rules(spark):
    docs = spark.createDataFrame(
        [(1, "red apple", "a red apple pie"), (2, "blue", "an aple is red"), (3, "red", "apple far far red"),
         (4, "none", "nothing")], "id LONG, title STRING, summary STRING")
    out = search.search(docs, "red apple").collect()
    assert [r["id"] for r in out] == [1, 3, 2]
    assert out[0]["proximity"] == 1 and out[-1]["typos"] == 1


def test_cotagged_hot_tag(spark):
    rows = [(f"File:{i}", "Tag:hot", "TAGGED") for i in range(50)] + [("File:1", "Tag:x", "TAGGED")]
    got = graph.cotagged(spark.createDataFrame(rows, "src STRING, dst STRING, rel STRING")).collect()
    assert [tuple(r) for r in got] == [("Tag:hot", "Tag:x", 1)]
