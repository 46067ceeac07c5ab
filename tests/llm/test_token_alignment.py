import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from opsloom.llm import token_alignment
from opsloom.llm.token_alignment import Pair, aligned, align_tokens, divide, token_groups
from opsloom.llm.token_counts import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  two  blanks  ", "trailing ", "line \n one\n\n  two\t three", " leading", "\n", "tab\tend\t", "日本語テキスト" * 50,
       "🙂é ́x", "a" * 999, "<|endoftext|> <s> </s> <unk> <0x41>", "x\x1c y", "no  break", "▁ ▁a a▁b", "\x00 \x00",
       "　wide　blanks x", "don't  we'll", "ﬁ ½ Ⅷ Å", "1234567890 12 345", "a \u0085b"]


@pytest.fixture(scope="module")
def naive():
    """Every text whole through both libraries, offsets by adding up, groups and links by walking."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    of = byte_letters()
    names_a = {i: bytes(of[c] for c in n) for n, i in one.get_vocab(with_added_tokens=False).items()}
    names_b = {i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i)
               else two.id_to_piece(i).replace("▁", " ").encode() for i in range(two.get_piece_size())}

    def tokens(text):
        if not text:
            return [], []
        a, b, raw = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text), (" " + text).encode()
        good = raw == b"".join(names_a[i] for i in a) == b"".join(names_b[i] for i in b)
        return (a, b) if good else ([], [])

    def walk(a, b):
        groups, links, i, j, end_a, end_b = [], [], 0, 0, 0, 0
        at = (0, 0)
        while i < len(a):
            links.append((a[i], b[j]))
            to_a, to_b = end_a + len(names_a[a[i]]), end_b + len(names_b[b[j]])
            if to_a <= to_b:
                i, end_a = i + 1, to_a
            if to_b <= to_a:
                j, end_b = j + 1, to_b
            if to_a == to_b:
                groups.append((a[at[0]:i], b[at[1]:j]))
                at = (i, j)
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        return len(groups), links, text

    def run(texts):
        out, holders = [], Counter()
        for text in texts:
            a, b = tokens(text)
            n, links, groups = walk(a, b)
            holders.update(set(links))
            out.append((len(a), len(b), n, links, groups))
        best = defaultdict(int)
        for (x, _), n in holders.items():
            best[x] = max(best[x], n)
        return [(n_a, n_b, n, len(links), sum(holders[p] == best[p[0]] for p in links), sum(holders[p] for p in links),
                 hashlib.sha256(g.encode()).hexdigest() if g else "") for n_a, n_b, n, links, g in out]
    return run


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60))), min_size=1, max_size=4))
def test_division_finds_every_shared_end(texts):
    a, b, bounds, base = [], [], [0], 0
    for x, y in texts:
        a += sorted(base + i for i in x | {61})
        b += sorted(base + i for i in y | {61})
        bounds.append(len(a))
        base += 61
    got = divide(np.array(a), np.array(b), np.array(bounds))
    assert got.tolist() == [0] + [i + 1 for i, end in enumerate(a) if end in set(b)]


def rows(df):
    return sorted(tuple(str(r[c]) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                                            "groups_sha256")) for r in df.collect())


def want(naive, docs):
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    return sorted(tuple(map(str, (i, *r))) for (i, _), r in zip(texts, naive([t for _, t in texts])))


def test_every_document(tables, naive):
    docs = tables("documents")
    assert rows(align_tokens(docs, A, B)) == want(naive, docs)


@pytest.mark.parametrize("block_chars", [1, 100, 10**6])
def test_edges_and_blocks(spark, edges, empty, naive, block_chars):
    assert rows(align_tokens(edges, A, B, block_chars=block_chars)) == want(naive, edges)
    assert align_tokens(empty, A, B).collect() == []
    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id int, text string").coalesce(2)
    assert rows(align_tokens(odd, A, B, block_chars=block_chars)) == want(naive, odd)


def test_words_are_tokenized_like_whole_texts(naive):
    with open(A, "rb") as a, open(B, "rb") as b:
        pair = Pair(a.read(), b.read())
    assert pair.by_word
    by_word = aligned(pair, ODD)[:2]
    pair.by_word = False
    whole = aligned(pair, ODD)[:2]
    assert by_word[0].tolist() == whole[0].tolist() and by_word[1] == whole[1]


def test_groups_are_the_hashed_text(edges):
    hashes = {(r.doc_id, r.groups_sha256) for r in align_tokens(edges, A, B).collect()}
    got = {(r.doc_id, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
           for r in token_groups(edges, A, B).collect()}
    assert got == hashes
