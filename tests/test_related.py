"""Classes of related files and related vectors against all pairs; groups of many near copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.operators.graph import components
from opsloom.functions import text
from opsloom.operators import similar
from opsloom.operators.similar import related, related_classes
from opsloom.operators.vectors import related_vectors

WORDS = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("ar", "el", "in", "os", "un")]


def text_of(draw, n=40):
    return " ".join(draw.choices(WORDS, k=n))


def sets_of(texts):
    out = {}
    for i, t in texts:
        if t is None:
            continue
        w = [x for x in "".join(c if c.isalpha() else " " for c in t.lower()).split()]
        out[i] = {tuple(w[j:j + 3]) for j in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)}
    return out


def brute_classes(texts, threshold):
    sets, label = sets_of(texts), {i: i for i, _ in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-12:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: root(i) for i in label}


@pytest.mark.parametrize("growth", [8, 64])
def test_classes_are_those_of_all_pairs(spark, growth):
    draw = random.Random(growth)
    seeds = [text_of(draw) for _ in range(6)]
    texts = []
    for i in range(160):                                     # copies with more and more words changed, so chains arise
        words = draw.choice(seeds).split()
        for _ in range(draw.randrange(0, 9)):
            words[draw.randrange(len(words))] = draw.choice(WORDS)
        texts.append((i, " ".join(words)))
    texts += [(200, None), (201, None), (202, ""), (203, "  "), (204, "bar"), (205, "bar"), (206, seeds[0])]
    df = spark.createDataFrame(texts, "file_id LONG, text STRING").repartition(5)
    classes, links = related_classes(df, 0.6, growth=growth)
    rows = {r.file_id: r for r in classes.collect()}
    want = brute_classes(texts, 0.6)
    assert {i: r.class_id for i, r in rows.items()} == want
    assert all(r.members == sum(c == r.class_id for c in want.values()) for r in rows.values())
    sets = sets_of(texts)
    for r in links.collect():
        assert abs(len(sets[r.src] & sets[r.dst]) / len(sets[r.src] | sets[r.dst]) - r.score) < 1e-9 and r.score >= 0.6


def test_a_large_group_costs_its_members(spark):
    draw = random.Random(3)
    base = text_of(draw, 60).split()
    texts = []
    for i in range(2000):
        words = list(base)
        words[i % 60] = f"x{chr(97 + i // 60 % 26)}{chr(97 + i // 1560)}"
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts, "file_id LONG, text STRING")
    classes, links = related_classes(df, 0.6)
    assert classes.filter("class_id = 0 AND members = 2000").count() == 2000
    assert links.count() <= 10 * 2000


def near_copies(draw, m):
    base = text_of(draw, 60).split()
    for i in range(m):
        yield " ".join([*base[:i % 50], f"q{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}", *base[i % 50 + 1:]])


@pytest.mark.parametrize("size", [7, 256])
def test_edges_are_those_of_all_pairs_whatever_the_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(similar, "BLOCK_SETS", size)
    monkeypatch.setattr(similar, "BLOCK_COLUMNS", 50)
    draw = random.Random(size)
    texts = list(enumerate([*near_copies(draw, 90), *near_copies(draw, 30), *(text_of(draw) for _ in range(30))]))
    texts += [(200, None), (201, ""), (202, " "), (203, "bar"), (204, "bar"), (205, "gar gar gar gar gar"), (206, texts[3][1])]
    got = related(spark.createDataFrame(texts, "file_id LONG, text STRING").repartition(5), 0.6).collect()
    sets = sets_of(texts)
    kept = [i for i, _ in texts if i not in (200, 204, 206)]
    want = {(i, j): s for x, i in enumerate(kept) for j in kept[x + 1:]
            if (s := len(sets[i] & sets[j]) / len(sets[i] | sets[j])) >= 0.6} | {(203, 204): 1.0, (3, 206): 1.0}
    want.pop((201, 202), None)
    found = {(r.src, r.dst): r.score for r in got}
    found.pop((201, 202), None)
    assert len(got) - len(found) <= 1 and found.keys() == want.keys() and len(want) > 4000
    assert all(abs(found[k] - want[k]) < 1e-12 for k in want)


def test_blocks_meet_instead_of_files(spark):
    texts = list(enumerate(near_copies(random.Random(5), 600)))
    _, hashed = similar.folded(spark.createDataFrame(texts, "file_id LONG, text STRING"), "file_id", "text")
    rare = similar.rare_items(hashed, 0.6)
    meets = similar.meeting_blocks(rare.join(similar.blocks_of(rare), "id"), 0.6)
    assert 0 < meets.count() <= 40                            # 179,700 pairs of files


def test_shingle_sets_are_those_of_the_expressions(spark, monkeypatch):
    monkeypatch.setattr(similar, "RUNS", 3)
    texts = [(1, "A b c d e f a b c"), (2, "Été à l'été, ßtraße"), (3, ""), (4, "one two"), (5, None), (6, "x y z x y z x y z")]
    df = spark.createDataFrame(texts, "file_id LONG, text STRING")
    _, hashed = similar.folded(df, "file_id", "text")
    got = {r.id: r.set and sorted(r.set) for r in hashed.collect()}
    want = df.select("file_id", text.words("text").alias("w")).select(
        "file_id", F.transform(text.shingles(F.col("w")), lambda s: text.hash_number(s) % similar.PRIME).alias("set"))
    assert got == {r.file_id: None if r.file_id == 5 else sorted({*r.set}) for r in want.collect()}


def test_shared_items_by_ranges_and_hot(spark, monkeypatch):
    monkeypatch.setattr(similar, "RANGE_ITEMS", 50)
    draw = random.Random(8)
    sets = [(f"k{i}", sorted({1, *draw.sample(range(2, 400), 12)})) for i in range(60)] + [("none", None)]
    rows = similar.shared_items(spark.createDataFrame(sets, "id STRING, set ARRAY<LONG>")).collect()
    df = {}
    for _, s in sets[:-1]:
        for x in s:
            df[x] = df.get(x, 0) + 1
    assert sorted((r.id, r.n, r.df, r.item) for r in rows) == sorted(
        (i, len(s), df[x], x) for i, s in sets[:-1] for x in s if df[x] > 1)
    assert similar.shared_items(spark.createDataFrame([], "id LONG, set ARRAY<LONG>")).collect() == []


def test_hot_items_are_looked_for_only_where_sets_are_small(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(similar, "heavy_keys", lambda *a: asked.append(a) or [(1, 0.1)])
    for n in (10, 400):
        sets = spark.createDataFrame([(i, [1, *range(i * n + 2, i * n + n + 1)]) for i in range(4)], "id LONG, set ARRAY<LONG>")
        assert {(r.id, r.df, r.item) for r in similar.shared_items(sets).collect()} == {(i, 4, 1) for i in range(4)}
    assert len(asked) == 1


def test_components(spark):
    n = 300
    chain = [(i, i + 1) for i in range(n) if i % 100 != 99] + [(5, 5), (7, 6)]
    labels = spark.createDataFrame([(i, i) for i in range(n)], "id LONG, label LONG")
    got = components(labels, spark.createDataFrame(chain, "src LONG, dst LONG"))
    assert {tuple(r) for r in got.collect()} == {(i, i // 100 * 100) for i in range(n)}


def vector_table(spark, x):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * x.shape[1]), (902, [1.0]), (903, rows[0][1]), (904, rows[0][1]), (None, rows[1][1])]
    return spark.createDataFrame(rows, "id LONG, embedding ARRAY<DOUBLE>").repartition(4)


def brute_pairs(x, cosine):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    return {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= cosine}


def test_vectors_all_patterns_and_some(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16))
    x = centres[rng.integers(0, 40, 600)] + 0.35 * rng.standard_normal((600, 16))
    want = brute_pairs(x, 0.85)
    pairs = {(r.src, r.dst): r.score for r in related_vectors(vector_table(spark, x), 0.85, recall=None, planes=6).collect()}
    assert {p for p in pairs if p[1] < 900} == want and len(want) > 1000
    assert pairs[0, 903] == pairs[0, 904] == 1.0 and (903, 904) not in pairs and len(pairs) == len(want) + 2
    some = {(r.src, r.dst) for r in related_vectors(vector_table(spark, x), 0.85, planes=6).collect()}
    assert len(some & want) >= 0.9 * len(want) and some - {(0, 903), (0, 904)} <= want


def test_a_third_of_all_vectors_in_one_pattern(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 8))
    x[:100] = 1 + 0.01 * rng.standard_normal((100, 8))
    got = related_vectors(vector_table(spark, x), 0.95, recall=None, planes=3, block_bytes=8 * 8 * 20)
    assert {(r.src, r.dst) for r in got.filter(F.col("dst") < 900).collect()} == brute_pairs(x, 0.95)
    assert related_vectors(vector_table(spark, x).filter("false"), 0.9).collect() == []
