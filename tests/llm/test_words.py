import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm.words import blocks, pieces, shingles, sliding_minimum, spoken, word_hashes

TEXT = st.text(alphabet="abZ9 .-\n[]()éß\0", max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=8), st.integers(1, 40))
def test_words_of_blocks(texts, size):
    texts = [spoken(t) for t in texts]
    got = [[] for _ in texts]
    for first, last, w in blocks(texts, size):
        for i in range(len(w.hash)):
            word = w.joined(i, 1)
            assert word_hashes([word])[0] == w.hash[i]
            got[first + w.text[i]].append(word)
    assert got == [re.findall("[a-z0-9]+", t) for t in texts]


def test_spoken():
    assert spoken("A [b (c] d) sup-\n ports (x\ny) IT-\n") == "a   d) supports   it-\n"
    assert spoken("") == ""


def test_shingles_and_minima():
    (_, _, w), *_ = blocks(["a b c d", "b c d"])
    s = shingles(w, 3)
    assert s[1] == s[4] and s[0] != s[1] and s[2] == s[3] == np.iinfo(np.uint64).max
    assert len(shingles(w, 9)) == 0
    rnd = np.random.default_rng(1).integers(0, 99, 50).astype(np.uint64)
    for n in range(1, 12):
        assert sliding_minimum(rnd, n).tolist() == [rnd[i : i + n].min() for i in range(50 - n + 1)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab9 .-\n", max_size=80), st.integers(0, 3), st.integers(1, 30))
def test_pieces_keep_every_run_of_words(text, overlap, size):
    find = lambda t: re.findall("[a-z0-9]+", t)
    runs = lambda w: {tuple(w[i : i + overlap + 1]) for i in range(len(w) - overlap)}
    parts = pieces(text, overlap, size)
    assert set().union(*(runs(find(p)) for p in parts)) == runs(find(text))
    assert overlap or [w for p in parts for w in find(p)] == find(text)
