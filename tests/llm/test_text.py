from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from meshwright.llm.textvec import chunks, shingles, string_buffers, words

WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 é.É\n", max_size=30)), max_size=8))
def test_words_are_those_of_a_regular_expression(texts):
    raw, offsets = string_buffers(pa.array(texts, pa.string()))
    h, first = words(raw, offsets)
    own = [[w.decode().lower() for w in WORD.findall((t or "").encode())] for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in own]
    flat = [w for ws in own for w in ws]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


@given(st.lists(st.integers(0, 50), min_size=1, max_size=20), st.integers(1, 60))
def test_chunks_cover(sizes, most):
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    got = list(chunks(offsets, most))
    assert [a for a, _ in got[1:]] == [b for _, b in got[:-1]] and got[0][0] == 0 and got[-1][1] == len(sizes)
    assert all(b == a + 1 or offsets[b] - offsets[a] <= most for a, b in got)


def test_shingles():
    raw, offsets = string_buffers(pa.array(["a b c d", "a b", "", "b c d"]))
    s, begin = shingles(*words(raw, offsets), 3)
    assert begin.tolist() == [0, 2, 3, 3, 4] and s[1] == s[3] and s[0] != s[1]
