import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from opsloom.llm import language_model as lm


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def brute(rows, deleted):
    """All result columns by dictionaries; the mixture weights come from the same EM on the same grid."""
    texts = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    words, pairs, less_words, less_pairs = Counter(), Counter(), Counter(), Counter()
    for i, t in texts:
        if not held_out(i):
            own = Counter(zip([None, *t[:-1]], t))
            words.update(t)
            pairs.update(own)
            if i not in deleted:
                less_words.update(t)
                less_pairs.update(own)
    n, v, less = sum(words.values()), len(words), sum(less_words.values())
    grid = Counter()
    for i, t in texts:
        if i in deleted:
            for a, w in zip([None, *t[:-1]], t):
                c = np.array([less_words[a]])
                grid[(int(lm.bucket(c)[0]), int(lm.cell(np.array([less_pairs[a, w] / max(c[0], 1)]))[0]),
                      int(lm.cell(np.array([less_words[w] / max(less, 1)]))[0]))] += 1
    cells = pd.DataFrame([(*k, x) for k, x in sorted(grid.items())], columns=["bucket", "pair", "word", "n"])
    weights = lm.mixture_weights(cells, v)
    out = []
    for i, t in texts:
        score = 0.0
        for a, w in zip([None, *t[:-1]], t):
            l2, l1, l0 = weights[int(lm.bucket(np.array([words[a]]))[0])]
            score += math.log10(l2 * pairs[a, w] / max(words[a], 1) + l1 * words[w] / max(n, 1) + l0 / (v + 1))
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        out.append((i, held_out(i), len(t), sum(words[w] > 0 for w in t), n, base, score))
    return sorted(out, key=repr)


def check(docs, **args):
    stored = lm.blocks(docs).where(f"role = {lm.DELETED}").collect()
    deleted = {i for r in stored for i in r.ids}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in lm.score_texts(docs, **args).collect()), key=repr)
    want = brute(rows, deleted)
    assert [(g[0], *g[1:5]) for g in got] == [(w[0], *w[1:5]) for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_table_as_brute_force_in_many_blocks_and_ranges(tables):
    check(tables("documents"), block_bytes=20_000, range_tokens=5_000)


def test_edges(edges, empty):
    check(edges)
    assert lm.score_texts(empty).collect() == []


def test_without_training_texts(spark):
    ids = [i for i in range(60) if held_out(i)]
    docs = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")
    rows = lm.score_texts(docs).collect()
    assert len(rows) == len(ids) and all(r.n_known == 0 and r.train_tokens == 0 and r.score == 0 - r.n_tokens * 0
                                         or r.score <= 0 for r in rows)


def test_better_than_the_base_and_packing():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64) * 2 + 1)
    assert np.array_equal(lm.unpack_keys(lm.pack_keys(keys)), keys)
    counts = rng.integers(0, 10**12, 1000)
    assert np.array_equal(lm.unpack_counts(lm.pack_planes(counts)), counts)


def test_model_beats_unigrams_on_held_out_texts(spark):
    rows = lm.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    held = rows[rows.held_out]
    assert held.score.sum() > held.base_score.sum()
