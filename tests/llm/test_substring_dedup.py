import pyarrow as pa

from conftest import prose  # noqa: F401  (tests/llm/conftest.py)
from opsloom.llm.substring_dedup import CUT_EVERY, SENTENCES, WORDS, but_the_first, remove_repeats
from opsloom.llm.tokens import chunks


def name_of(word):
    return int(next(chunks(pa.array([word]))).hashes()[0])


def parts(text):
    """Sentences of a text as lists of words, by plain string steps."""
    out, now = [], []
    for line in (text or "").split("\n"):
        for word in line.encode().split():
            word = word.decode()
            now.append(word.lower().encode() if word.isascii() else word.encode().lower())
            if word[-1] in ".!?" or name_of(word) % CUT_EVERY == 0:
                out.append(now)
                now = []
        if now:
            out.append(now)
            now = []
    return out


def brute(rows):
    """(doc_id, number of removed sentences) for every row with distinct ids."""
    texts = {i: parts(t) for i, t in rows}
    first, spans = {}, []
    for i in sorted(texts):
        own = texts[i]
        for a in range(len(own)):
            b = a + SENTENCES
            while b <= len(own) and sum(map(len, own[a:b])) < WORDS:
                b += 1
            if b <= len(own):
                key = tuple(w for s in own[a:b] for w in s)
                spans.append((key, i, a, b))
                first.setdefault(key, (i, a))
    gone = {i: set() for i in texts}
    for key, i, a, b in spans:
        if first[key] != (i, a):
            gone[i].update(range(a, b))
    return {i: (len(texts[i]), len(gone[i])) for i in texts}


def applied(old, removed):
    out, at = "", 0
    for r in removed:
        out, at = out + old[at:r["start"]], r["end"]
    return out + old[at:]


def test_table_as_brute_force(spark):
    rows = [(i, prose(i, 60 + i)) for i in range(40)]
    passage = prose(999, 70)
    rows += [(100 + i, f"{prose(200 + i, 15)} {passage} {prose(300 + i, 15)}\n{prose(400 + i, 9)}") for i in range(12)]
    rows += [(200, rows[3][1]), (201, ""), (202, None), (203, "a. b. c."), (204, "a. b. c.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, old = brute(rows), dict(rows)
    for r in remove_repeats(docs).collect():
        assert (r.n_sentences, r.n_removed) == want[r.doc_id], r.doc_id
        if r.n_removed:
            assert applied(old[r.doc_id], r.removed) == r.text
        else:
            assert (r.text or "") == (old[r.doc_id] or "")
    assert sum(w[1] > 0 for w in want.values()) == 12


def test_edges(edges, empty):
    old = {r.doc_id: r.text for r in edges.where("doc_id IS NOT NULL AND doc_id NOT IN (6, 7)").collect()}
    rows = remove_repeats(edges).collect()
    assert len(rows) == edges.count()
    for r in rows:
        if r.doc_id in (8, 9):
            assert r.n_removed > 0
        elif r.doc_id in old:
            assert (r.n_removed == 0 and r.text == old[r.doc_id]) or r.doc_id in (5, 12)
    assert all(r.n_removed == 0 for r in rows if r.doc_id in (6, 7, None, 1, 2, 3, 4))
    assert remove_repeats(empty).collect() == []


def test_passages_of_fifty_words_go_from_all_texts_but_one(spark):
    passage = prose(77, 55)
    docs = spark.createDataFrame([(i, f"{prose(500 + i, 30)} {passage} {prose(700 + i, 30)}") for i in range(50)],
                                 "doc_id long, text string")
    rows = remove_repeats(docs).orderBy("doc_id").collect()
    assert rows[0].n_removed == 0 and all(r.n_removed > 0 for r in rows[1:])
    middle = " ".join(passage.split()[15:40])
    assert sum(middle in r.text for r in rows) == 1


def test_passages_without_cuts_go_to_the_last_word(spark):
    words = (f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "bdfgklmnprst")
    words = [w for w in words if name_of(w) % CUT_EVERY]     # no sign and no word to cut at
    passage, rows = " ".join(words[:51]), []
    for i in range(8):
        before, after = (" ".join(f"x{side}{i}y{k}" for k in range(40)) for side in "lr")
        rows.append((i, f"{before} {passage} {after}"))
    rows.append((8, rows[0][1] + " end"))        # the passage is inside a longer repeat here and in row 0
    del rows[1:3]
    for some in (rows, rows[:1] + rows[-2:]):
        got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(some, "doc_id long, text string")).collect()}
        assert got[0].text == rows[0][1] and got[8].text == "end"
        for i, old in some[1:-1]:
            assert got[i].text == old.replace(passage + " ", ""), i
            assert applied(old, got[i].removed) == got[i].text


def test_first_rows_stay_across_batches(spark):
    """Keys of one and of many rows, equal rows, and a key that goes over several Arrow batches."""
    rows = [(7, d, a, 1) for d in range(30) for a in (3, 9)] + [(7, 0, 3, 1), (8, 5, 1, 2), (-9, 4, 2, 0), (-9, 3, 8, -1)]
    df = spark.createDataFrame(rows, "key long, doc_id long, at long, size long").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, but_the_first(df).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted([(d, a, 1) for d in range(30) for a in (3, 9) if (d, a) != (0, 3)] + [(4, 2, 0)])
    assert but_the_first(df.where("false")).collect() == []
