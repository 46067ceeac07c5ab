import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from opsloom.llm.tokens import SPACE, chunks, shingles

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abAB é\n\t\x0b\x1c.!", max_size=40)), max_size=12)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_words_and_hashes_are_those_of_the_bytes(texts, size):
    seen, names = 0, {}
    for chunk in chunks(pa.array(texts, pa.string()), SPACE, size):
        hashes = chunk.hashes()
        assert chunk.first == seen
        for i in range(chunk.n):
            words = (texts[seen + i] or "").encode().lower().split()
            own = hashes[chunk.bounds[i]:chunk.bounds[i + 1]].tolist()
            assert len(own) == len(words)
            for word, name in zip(words, own):
                assert names.setdefault(word, name) == name
        seen += chunk.n
    assert seen == len(texts) and len(set(names.values())) == len(names)


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(2, 4))
def test_shingles_are_equal_where_their_words_are(texts, k):
    names = {}
    for chunk in chunks(pa.array(texts, pa.string())):
        hashes = chunk.hashes()
        found, bounds = shingles(chunk, hashes, k)
        for i in range(chunk.n):
            words = (texts[chunk.first + i] or "").encode().lower().split()
            want = [tuple(words[j:j + k]) for j in range(len(words) - k + 1)] or ([tuple(words)] if words else [])
            own = found[bounds[i]:bounds[i + 1]].tolist()
            assert len(own) == len(want)
            for shingle, name in zip(want, own):
                assert names.setdefault(shingle, name) == name
    assert len(set(names.values())) == len(names)


def test_slices_and_empty_columns():
    column = pa.array(["a b", None, "c", ""]).slice(1, 3)
    assert [c.counts.tolist() for c in chunks(column)] == [[0, 1, 0]]
    assert list(chunks(pa.array([], pa.string()))) == []
    assert np.all(next(chunks(pa.chunked_array([["x y"], ["z"]]))).counts == [2, 1])
