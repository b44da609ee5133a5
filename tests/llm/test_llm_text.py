import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import text as T

ALPHABET = st.text(alphabet="abAB \t\nß9é.@🙂", max_size=30)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), ALPHABET), max_size=8), st.integers(1, 40))
def test_words_are_the_pattern_whatever_the_piece(texts, piece):
    old, T.PIECE = T.PIECE, piece
    try:
        data, offs = T.buffers(pa.array(texts, pa.string()))
        for inside, pattern, fold in ((T.NOT_SPACE, r"[^\x20\x09-\x0D]+", None), (T.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", T.LOWER)):
            w = T.words(data, offs, inside, fold)
            seen = {}
            for d, h, s, e in zip(w.doc, w.hash, w.start, w.end):
                word = data[s:e].tobytes().decode()
                if fold is not None:
                    word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
                assert seen.setdefault(word, h) == h
            assert len(set(seen.values())) == len(seen)
            want = [(i, m) for i, t in enumerate(texts)
                    for m in re.findall(pattern, "".join(c.lower() if fold is not None and "A" <= c <= "Z" else c for c in t or ""))]
            got = [(d, data[s:e].tobytes().decode()) for d, s, e in zip(w.doc, w.start, w.end)]
            assert [(d, "".join(c.lower() if fold is not None and "A" <= c <= "Z" else c for c in x)) for d, x in got] == want
    finally:
        T.PIECE = old


@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 21))
@settings(max_examples=60, deadline=None)
def test_window_hashes_agree_exactly_with_equal_windows(values, k):
    h = T.mix(np.array(values, np.uint64))
    got = T.windows(h, k)
    assert len(got) == max(0, len(values) - k + 1)
    seen = {}
    for i, g in enumerate(got):
        assert seen.setdefault(tuple(values[i:i + k]), g) == g
    assert len(set(seen.values())) == len(seen)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=30))
@settings(max_examples=60, deadline=None)
def test_packed_keys_come_back(values):
    keys = np.unique(np.array(values, np.uint64))
    assert (T.unpack_sorted(T.pack_sorted(keys)) == keys).all()
    assert (T.unplanes(T.planes(keys), np.uint64) == keys).all()
