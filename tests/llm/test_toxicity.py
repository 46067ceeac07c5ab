import numpy as np

from opsloom.llm import toxicity
from opsloom.llm.toxicity import Chain, fit, fit_chain, kinds_of, least_cut, predict, without_toxic


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels.where("doc_id % 4 <> 0"))
    rows = predict(docs, model).toPandas().merge(labels.where("doc_id % 4 = 0").toPandas(), on="doc_id")
    toxic, clean = rows[rows.toxic == 1], rows[rows.toxic == 0]
    assert toxic.is_toxic.mean() > 0.82 and clean.is_toxic.mean() < 0.01
    by_language = toxic.merge(docs.select("doc_id", "lang").toPandas(), on="doc_id").groupby("lang").is_toxic.mean()
    assert set(by_language.index) == {"de", "en", "es", "fr"} and by_language.min() > 0.5, by_language


def test_later_models_use_earlier_categories():
    rng = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(1500):
        first = rng.random() < 0.5
        words = rng.integers(10, 200, 6)
        rows.append(np.unique(np.append(words, 3 if first else 4)))
        y.append((int(first), int(first)))
    chain = fit_chain(np.arange(1500), rows, np.array(y), ["a", "b"], 8)
    assert chain.earlier[1, 0] > 0.5
    p = chain.probabilities(np.array([[w[i].sum() for w in chain.words] for i in rows]))
    assert ((p[:, 1] >= 0.5) == np.array(y)[:, 1]).mean() > 0.95


def test_edges(edges, empty, labels):
    model = fit(edges, labels)
    rows = predict(edges, model).collect()
    assert len(rows) == edges.count() and predict(empty, model).collect() == []
    assert len({r.p_toxic for r in rows if r.doc_id in (1, 2, 3)}) == 1
    left = without_toxic(edges, model)
    assert left.columns == edges.columns
    assert left.count() == sum(not r.is_toxic for r in rows)
    none = fit(edges, labels.where("false"))
    assert not any(r.is_toxic for r in predict(edges, none).collect())


def test_signs_and_capitals_hide_nothing(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} " + ("an idiot here" if i % 5 == 0 else "all is fine")) for i in range(400)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = fit(docs, labels)
    new = spark.createDataFrame([(1, "w1 an IDIOT!!! here"), (2, "w1 ***idiot***"), (3, "w2 all is fine")], "doc_id long, text string")
    assert [r.is_toxic for r in predict(new, model).orderBy("doc_id").collect()] == [True, True, False]
    assert model.names[-1] == "toxic" and toxicity.CUT > 0.5


def test_scores_are_those_of_a_plain_walk_along_the_chain(spark):
    """Words and beginnings by hand, weights by dictionary, one category after the other."""
    words = [f"w{i}x" for i in range(40)] + ["longer", "longerword", "ünïcodé", "beginning", "beginnings"]
    rng = np.random.default_rng(8)
    texts = [(i, " ".join(rng.choice(words, rng.integers(0, 12)))) for i in range(60)]
    chain = Chain(["a", "b", "c"], rng.normal(size=(3, 1 << 12)).astype(np.float32), np.tril(rng.normal(size=(3, 3)), -1),
                  rng.normal(size=3), 12, 0.7)
    rows = {r.doc_id: r for r in predict(spark.createDataFrame(texts, "doc_id long, text string"), chain).collect()}
    numbers = {}

    def number(piece, salt):
        from opsloom.llm.tokens import LOWER_CODES, NOT_ALNUM, U64, chunks, mix, random_words
        import pyarrow as pa
        chunk = next(chunks(pa.array(["xy " + piece.decode("utf-8", "replace")]), NOT_ALNUM))
        raw = np.frombuffer(piece, dtype=np.uint8)
        h = chunk.ranges(LOWER_CODES[raw], np.array([0]), np.array([len(raw)]))
        return int((mix(h ^ random_words(1, 60 + salt)[0]) if salt else h)[0] >> U64(64 - 12))

    for i, text in texts:
        features = set()
        for w in text.split():
            raw = w.encode()
            features.add(numbers.setdefault((raw, 0), number(raw, 0)))
            features |= {numbers.setdefault((raw[:n], n), number(raw[:n], n)) for n in toxicity.BEGINNINGS if len(raw) > n}
        p = []
        for k in range(3):
            margin = sum(float(chain.words[k][f]) for f in features) + sum(x * y for x, y in zip(p, chain.earlier[k]))
            p.append(1 / (1 + np.exp(-(margin + chain.intercept[k]))))
        got = rows[i]
        assert np.allclose([got.p_a, got.p_b, got.p_c], p, atol=1e-9) and got.is_toxic == (p[2] >= 0.7)


def test_the_cut_lies_halfway():
    p, y = np.array([0.99, 0.95, 0.9, 0.6, 0.2]), np.array([1, 1, 1, 0, 0])
    assert 0.6 < least_cut(p, y) < 0.9
    assert least_cut(p, np.zeros(5)) == toxicity.CUT == least_cut(np.zeros(0), np.zeros(0))


def test_kinds_follow_what_stands_out():
    rng = np.random.default_rng(3)
    rows, toxic = [], []
    for i in range(600):
        own = [1, 2, 3] if i % 6 == 0 else [5, 6, 7] if i % 6 == 1 else []
        rows.append(np.unique(np.append(rng.integers(20, 250, 8), own)).astype(int))
        toxic.append(int(bool(own)))
    kind = kinds_of(rows, np.array(toxic), 256, 2)
    assert set(kind[0::6]) != set(kind[1::6]) and len(set(kind[0::6])) == len(set(kind[1::6])) == 1
    assert set(kind[2::6]) == {-1}


def test_features_of_all_rows_are_never_one_array():
    import tracemalloc

    from opsloom.llm.toxicity import standing_out
    rng = np.random.default_rng(1)
    rows, y = [rng.integers(0, 4096, 400).astype(np.int32) for _ in range(8000)], np.arange(8000) % 2
    tracemalloc.start()
    found = standing_out(rows, y, 4096)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.shape == (4096,) and peak < 8000 * 400 * 4        # all features at once take this much, and twice as 64 bits
