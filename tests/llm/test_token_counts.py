import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from opsloom.llm import token_counts
from opsloom.llm.token_counts import Machine, count_tokens, scan

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  \n\t ", "é" * 5000, "a" * 3000, "abc" * 2000, "'" * 700, "ab'" * 500, "🙂" * 700, "日本語テキスト" * 300,
       "don't we'll I'VE 're'x 'l 'r '' ''s !'s 'st 'rest 'v", "x1y2'll've" * 90, "1" * 900,
       "<|startoftext|>hi<|endoftext|>x<|endoftext", "e<|endoftext|>́", "İstanbul ΑΣ ΣΑΣ ﬁ Å e´ é",
       "١٢٣½ⅷ²", "\x00\x1c\x85x​", " x　y"]
ALPHABETS = ["ab", "aeiou ", "thein ", "'srelvtdm x!", "äöüßéñ aeß", "ABCdefG0123456789+/", "日本é🙂 a1'",
             "ĿŀİΣσς'ſK", "̀́aeo "]


@pytest.fixture(scope="module")
def machine():
    with open(PATH, "rb") as file:
        return Machine(file.read())


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_counts_are_those_of_the_library(machine, library):
    draw = random.Random(5)
    texts = ODD + ["".join(draw.choices(draw.choice(ALPHABETS), k=draw.choice([3, 10, 40, 300, 1500])))
                   for _ in range(600)]
    assert machine.count(texts).tolist() == library(texts)


def test_a_new_start_of_the_machine_changes_nothing(machine, library, monkeypatch):
    monkeypatch.setattr(token_counts, "STATES", 10)
    assert [machine.count([t])[0] for t in ODD] == library(ODD)
    assert len(machine.states) < 3000


def test_chunks_without_cuts_follow_the_true_chain(machine, library, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 16)
    monkeypatch.setattr(token_counts, "LOOK_BACK", 1)       # guesses are bad
    monkeypatch.setattr(token_counts, "CANDIDATES", 2)
    texts = ["é" * 999, "aa" * 700 + "b", "abc" * 500, "thethethein" * 99, "x" * 33, "don't" * 150]
    assert machine.count(texts).tolist() == library(texts)


def test_scan_composes_maps():
    maps = [{0: (5, 1)}, {3: (4, 2), 5: (6, 2)}, {6: (7, 3)}, {0: (9, 1)}, {8: (1, 1)}]
    assert scan(maps, np.array([True, False, False, True, False])) == [0, 5, 6, 0, -1]


def test_every_document(spark, tables, library):
    docs = tables("documents")
    got = {r.doc_id: r for r in count_tokens(docs, PATH).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == len(texts)
    for doc_id, n in zip(texts, library(list(texts.values()))):
        r = got[doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[doc_id].encode()), n, n > 2048)


def test_edges(edges, empty, library):
    rows = count_tokens(edges, PATH).collect()
    want = [(r.doc_id, r.text or "") for r in edges.collect()]
    counts = library([t for _, t in want])
    assert sorted(map(str, [(r.doc_id, r.n_bytes, r.n_tokens) for r in rows])) == sorted(
        map(str, [(i, len(t.encode()), n) for (i, t), n in zip(want, counts)]))
    assert count_tokens(empty, PATH).collect() == []
    assert count_tokens(empty, PATH).dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"),
                                                ("over_limit", "boolean")]
