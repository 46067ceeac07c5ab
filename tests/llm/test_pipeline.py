import corpus_pipeline
from opsloom.llm.minhash import near_duplicates
from opsloom.llm.mixing import mix_sql
from opsloom.llm.secret_scan import masked, spans_of
from opsloom.llm.toxicity import fit, predict
from test_minhash import brute
from test_mixing import same


def test_stages_as_plain_python(spark, tables, sf_dir):
    """Each stage on what its predecessor kept, against plain Python."""
    docs = tables("documents")
    names = docs.columns
    toxic = {r.doc_id for r in predict(docs, fit(docs, tables("labels"))).where("is_toxic").collect()}
    assert toxic
    now = {r.doc_id: r for r in docs.collect() if r.doc_id not in toxic}
    steps = dict(corpus_pipeline.STAGES)
    docs = steps["toxicity"](spark, docs, sf_dir).cache()
    assert docs.columns == names and {r.doc_id: r for r in docs.collect()} == now
    now = {i: now[i] for i, _, c in brute([(r.doc_id, r.text) for r in now.values()]) if i == c}
    docs = steps["near_duplicates"](spark, docs, sf_dir).cache()
    assert docs.columns == names and {r.doc_id: r for r in docs.collect()} == now
    before = len(now)
    items = [r.text for r in tables("benchmark").collect()]
    docs = steps["decontamination"](spark, docs, sf_dir).cache()
    now = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == names and before > len(now) > 0.8 * before
    assert not any(t in r.text for r in now.values() for t in items)
    docs = steps["secrets"](spark, docs, sf_dir).cache()
    assert docs.columns == names
    for r in docs.collect():
        old = now[r.doc_id]
        assert r.text == masked(old.text, spans_of(old.text), "<secret>") and r.n_chars == len(r.text)
    same(steps["mixing"](spark, docs, sf_dir), mix_sql(), docs.toArrow())


def test_run_is_its_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "text", "lang", "source", "n_chars", "copy", "mix_key"} == set(out.columns) and out.count() > 50


def test_stages_on_edges(spark, edges, labels, tmp_path):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "nothing that any text here holds at all or would ever hold")],
                          "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edges, folder)
        rows = out.collect()
        assert set(edges.columns) <= set(out.columns), name
        if name == "near_duplicates":
            ids = [r.doc_id for r in rows if r.doc_id is not None]
            assert len(ids) == len(set(ids)) and sum(r.doc_id is None for r in rows) == 2
            kept = {r.doc_id for r in near_duplicates(edges).collect() if r.kept and r.doc_id is not None}
            assert set(ids) == kept
        if name in ("secrets", "decontamination"):
            assert len(rows) == edges.count()
        assert stage(spark, edges.where("false"), folder).count() == 0
