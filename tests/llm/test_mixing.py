import duckdb

from parity import table_of
from opsloom.llm.mixing import mix_sources, mix_sql, source_rates, source_sizes

PLAIN = ["doc_id", "text", "lang", "source", "n_chars"]


def same(df, sql, rows):
    con = duckdb.connect()
    con.register("documents", rows)
    cur = con.execute(sql)
    want = table_of([d[0] for d in cur.description], cur.fetchall())
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == want


def test_edges_as_sql(edges):
    docs = edges.select(*PLAIN)
    same(mix_sources(docs), mix_sql(), docs.toArrow())


def test_join_beyond_the_broadcast_bound_gives_the_same(edges):
    docs = edges.select(*PLAIN)
    same(mix_sources(docs, broadcast_sources=0), mix_sql(), docs.toArrow())


def test_weights_rates_and_order(spark):
    docs = spark.createDataFrame([(i, "x" * 100, "en", "big" if i % 10 else "small", 100) for i in range(4000)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    weights = {"big": 0.5, "small": 0.5}
    rates = {r.source: r.rate for r in source_rates(source_sizes(docs), weights).collect()}
    assert abs(rates["small"] - 5) < 1e-9 and abs(rates["big"] - 5 / 9) < 1e-9
    out = mix_sources(docs, weights).toPandas()
    assert abs((out.source == "small").mean() - 0.5) < 0.05 and abs(len(out) - 4000) < 250
    small = out[out.source == "small"].groupby("doc_id").size().reindex(range(0, 4000, 10), fill_value=0)
    assert abs(small.mean() - 5) < 0.4 and abs(small.var() - 5) < 1.5      # Poisson: variance is the mean
    parts = mix_sources(docs, weights).select("mix_key").rdd.glom().map(lambda p: [r[0] for r in p]).collect()
    assert all(p == sorted(p) for p in parts)


def test_clashing_columns_and_empty(edges, empty):
    out = mix_sources(edges)
    assert sorted(out.columns) == sorted(edges.columns) and set(out.dtypes) >= {("copy", "int"), ("mix_key", "bigint")}
    assert mix_sources(empty).collect() == []
    same(mix_sources(edges.select(*PLAIN)), mix_sql(), edges.select(*PLAIN).toArrow())


def test_weights_may_leave_a_source_out(edges):
    got = mix_sources(edges, {"src1": 1.0})
    # sources of size 0 keep rate 1
    assert {r.source for r in got.select("source").distinct().collect()} <= {"src1", None}
