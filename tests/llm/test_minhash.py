import itertools
import random

from opsloom.llm.minhash import near_duplicates


def brute(rows):
    """component_id of every (doc_id, text) by comparing all pairs of distinct sets."""
    def shingle_set(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(i, shingle_set(t)) for i, t in rows]
    by_set = {}
    for i, s in sets:
        if s and i is not None:
            by_set[s] = min(i, by_set.get(s, i))
    names = {s: s for s in by_set}

    def top(s):
        while names[s] is not s:
            s = names[s]
        return s
    for a, b in itertools.combinations(by_set, 2):
        both = len(a & b)
        if 100 * both >= 75 * (len(a) + len(b) - both):
            x, y = top(a), top(b)
            if x is not y:
                names[y] = x
    least = {}
    for s, i in by_set.items():
        least[top(s)] = min(i, least.get(top(s), i))
    return sorted(((i, len(s), i if i is None or not s else least[top(s)]) for i, s in sets), key=repr)


def result(docs, **args):
    rows = near_duplicates(docs, **args).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


def test_whole_table_as_brute_force(tables):
    docs = tables("documents")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_edges(edges, empty):
    rows = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    got = result(edges)
    # rows that repeat an id are one document: its texts are reached through it
    assert [g for g in got if g[0] not in (6, 7, 8, 9)] == [b for b in brute(rows) if b[0] not in (6, 7, 8, 9)]
    assert {g[2] for g in got if g[0] in (6, 8, 9)} == {6}
    assert near_duplicates(empty).collect() == []


def test_large_group_of_near_copies_and_chains(spark):
    """Copies at many distances from one text, most of them not similar to each other directly."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for k in r.sample(range(120), r.randint(0, 6)):
            words[k] = f"x{r.randint(0, 40)}"
        rows.append((i, " ".join(words)))
    chain = list(base[:60])
    for i in range(30):
        chain = chain[2:] + [f"c{i}a", f"c{i}b"]
        rows.append((1000 + i, " ".join(chain)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(docs) == brute(rows)
