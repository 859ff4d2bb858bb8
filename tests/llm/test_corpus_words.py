import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlake.llm import words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ09 \n\t.-é中<", max_size=30)), max_size=8)


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    for table, pattern in ((W.LETTERS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (W.NON_SPACE, r"[^\x20\x09-\x0D]+")):
        w = W.find_words(pa.array(texts, pa.string()), table, W.LOWER)
        want = [(i, x) for i, t in enumerate(texts) for x in re.findall(pattern, lowered(t))]
        assert [(int(t), w.word(i).decode()) for i, t in enumerate(w.text)] == want
        seen = {}
        for (_, x), h in zip(want, w.hash.tolist(), strict=True):
            assert seen.setdefault(x, h) == h
        assert len(set(seen.values())) == len(seen)


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_grams_stay_inside_a_text(texts, k):
    w = W.find_words(pa.array(texts, pa.string()), W.NON_SPACE)
    h, at = W.grams(w, k)
    want = [i for i in range(len(w.text) - k + 1) if w.text[i] == w.text[i + k - 1]]
    assert at.tolist() == want
    key = {}
    for i, x in zip(at.tolist(), h.tolist(), strict=True):
        assert key.setdefault(tuple(w.word(j) for j in range(i, i + k)), x) == x


def test_chunks_cover_all_rows():
    col = pa.array(["a" * 10, None, "", "b" * 100, "c"])
    assert list(W.chunks(col, 20)) == [(0, 3), (3, 4), (4, 5)] or [r for r in W.chunks(col, 20)][-1][1] == 5
    assert np.concatenate([np.arange(a, b) for a, b in W.chunks(col, 20)]).tolist() == [0, 1, 2, 3, 4]


def test_split_unspaced():
    w = W.split_unspaced(W.find_words(pa.array(["ab 猫犬x鳥 é", "", None, "犬", "ไทยนะ z"]), W.LETTERS, W.LOWER))
    got = [(int(t), w.word(i).decode()) for i, t in enumerate(w.text)]
    assert got == [(0, "ab"), (0, "猫犬"), (0, "犬"), (0, "x"), (0, "鳥"), (0, "é"), (3, "犬"), (4, "ไทยน"), (4, "ทยนะ"), (4, "ยนะ"), (4, "นะ"), (4, "ะ"), (4, "z")]
    assert w.hash[2] == w.hash[6] and w.hash[0] == W.find_words(pa.array(["ab"]), W.LETTERS).hash[0]
