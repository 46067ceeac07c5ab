from opsloom.llm.decontamination import leaks, without_leaks

ASK = ("If Alice has 5 apples and Bob gives Alice 3 more apples how many apples does Alice have after 2 days in "
       "total?")
SAME = "So. If Carol has 7 apples and Dave gives Carol 9 more apples how many apples does Carol have after 4 days in total? Yes"
MIXED = "If Carol has 7 apples and Dave gives Erin 9 more apples how many apples does Frank have after 4 days in total?"
DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def found(spark, docs, items):
    rows = leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    return sorted((r.doc_id, r.item_id, r.exact) for r in rows)


def test_reparameterised_questions_need_consistent_slots(spark):
    docs = [(1, SAME), (2, MIXED), (3, "bla " + ASK + " bla"), (4, None), (5, ""), (6, "nothing of the kind " * 9)]
    assert found(spark, docs, [(9, ASK), (10, None), (11, "too short")]) == [(1, 9, False), (3, 9, True)]


def test_table_holds_every_item_found_by_search(spark, tables):
    docs, items = (tables(t).toPandas() for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in leaks(tables("documents"), tables("benchmark")).collect()}
    want = {(d, i) for i, t in zip(items.item_id, items.text) for d in docs[docs.text.str.contains(t, regex=False)].doc_id}
    assert want and want <= got

    def plain(text):
        words = (w.strip("".join(c for c in map(chr, range(33, 127)) if not c.isalnum())).lower() for w in text.split())
        return [w for w in words if w]
    texts, asked = dict(zip(docs.doc_id, docs.text)), dict(zip(items.item_id, items.text))
    for d, i in got - want:     # found on templates: words in a row are shared all the same
        a, b = plain(texts[d]), plain(asked[i])
        runs = {tuple(b[k:k + 5]) for k in range(len(b) - 4)}
        assert any(tuple(a[k:k + 5]) in runs for k in range(len(a) - 4))


def test_edges_and_stage(edges, empty, spark):
    text = edges.where("doc_id = 6").first().text
    items = spark.createDataFrame([(1, " ".join(text.split()[20:50])), (1, " ".join(text.split()[20:50])), (2, None)], ITEMS)
    assert {r.doc_id for r in leaks(edges, items).collect()} == {6, 8, 9}
    left = without_leaks(edges, items)
    assert left.columns == edges.columns and left.count() == edges.count() - 4
    assert left.where("doc_id IS NULL").count() == 2
    assert leaks(empty, items).collect() == [] == leaks(edges, items.where("false")).collect()


def test_many_copies_of_one_passage(spark):
    docs = [(i, f"intro{i} word{i} {ASK}") for i in range(300)]
    assert [d for d, _, _ in found(spark, docs, [(1, ASK)])] == list(range(300))


def test_a_clash_of_numbers_or_of_one_name_hides_nothing(spark):
    item = ("If Alice has 12 apples and Bob gives Alice 12 more apples then how many of the red apples does Alice have "
            "after 15 days when Bob eats one of them on every day?")
    docs = [(1, item.replace("12 more", "15 more")), (2, item.replace("15", "12")),
            (3, item.replace("12 apples", "3 apples").replace("12 more", "7 more").replace("Alice", "Eve")),
            (4, item.replace("when Bob", "when Alice"))]
    assert found(spark, docs, [(9, item)]) == [(i, 9, False) for i in (1, 2, 3)] + [(4, 9, True)]


def test_short_items_excerpts_and_other_case(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500))
    names = "Anna Müller Berta Özil Carl Weiß Doris Kern Emil Lang Franz Huber"
    items = [(1, "What is 7 times 8?"), (2, long), (3, names)]
    docs = [(1, "so what is 7 times 8 then"), (2, "x " + " ".join(long.split()[200:213]) + " y"),
            (3, "see " + names.lower()), (4, "what is 7 times 9"), (5, "x " + " ".join(long.split()[200:212]) + " y")]
    assert found(spark, docs, items) == [(i, i, True) for i in (1, 2, 3)]


def test_items_of_a_word_or_two_only_count_by_themselves(spark):
    items = [(1, "Paris"), (2, "the answer")]
    docs = [(1, "we went to Paris in spring"), (2, "Paris"), (3, "Which town?\n - Paris!\nYes"), (4, "It is. Paris. So"),
            (5, "this is the answer to all"), (6, "The answer"), (7, "parisian"), (8, "Paris, of course")]
    assert found(spark, docs, items) == [(2, 1, True), (3, 1, True), (4, 1, True), (6, 2, True)]
