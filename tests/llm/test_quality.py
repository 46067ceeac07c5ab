import re
from collections import Counter

import numpy as np

from opsloom.llm import quality_classifier, quality_rules
from opsloom.llm.quality_rules import COUNTS, FEATURES, MONOTONE, fit_trees


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    times = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if times[tuple(words[i:i + 3])] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def check_base(docs, labels):
    want = sorted(((r.doc_id, *base(r.text)) for r in docs.select("doc_id", "text").collect()), key=repr)
    rows = quality_rules.judge(docs, quality_rules.fit(docs, labels)).collect()
    assert sorted(((r.doc_id, *[r[c] for c in COUNTS]) for r in rows), key=repr) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    return rows


def test_rules_on_tables(tables):
    rows = check_base(tables("documents"), tables("labels"))
    quality = {r.doc_id: r.quality for r in tables("labels").collect()}
    judged = [(r.kept, quality[r.doc_id]) for r in rows if r.doc_id in quality and not r.base_failed]
    assert np.mean([k == (q == 1) for k, q in judged]) > 0.97


def test_rules_on_edges(edges, empty, labels):
    check_base(edges, labels)
    rows = check_base(edges, labels.where("false"))
    assert all(r.kept == (not r.base_failed) for r in rows)
    assert quality_rules.judge(empty, quality_rules.fit(empty, labels)).collect() == []


def test_trees_keep_their_directions():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(FEATURES)))
    y = (x[:, 2] + 0.4 * rng.random(3000) < 0.8).astype(float)
    y = np.where(rng.random(3000) < 0.1, 1 - y, y)
    model = fit_trees(x, y, quality_rules.directions())
    assert ((model.probability(x) >= 0.5) == y).mean() > 0.8
    for f, name in enumerate(FEATURES):
        if name in MONOTONE:
            low, high = x.copy(), x.copy()
            high[:, f] += rng.random(len(x))
            assert np.all(model.margin(high) <= model.margin(low) + 1e-12)


def test_classifier_on_held_out_rows(spark, tables):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.classify(docs, quality_classifier.fit(docs, labels)).toPandas()
    assert len(rows) == docs.count()
    held = rows[rows.held_out].merge(labels.toPandas(), on="doc_id")
    assert ((held.predicted == held.quality).mean()) > 0.95
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()


def test_classifier_on_edges(edges, empty, labels):
    import zlib
    weights = quality_classifier.fit(edges, labels)
    rows = quality_classifier.classify(edges, weights).collect()
    assert len(rows) == edges.count()
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    blank = {r.score for r in rows if r.doc_id in (1, 2, 3)}
    assert len(blank) == 1
    assert quality_classifier.classify(empty, weights).collect() == []
    none = quality_classifier.classify(edges, quality_classifier.fit(edges, labels.where("false"))).collect()
    assert {r.score for r in none} == {0.5}
