from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from meshwright.llm.substrings import Index, WaveletMatrix, anchors, covered, grams, repeated_passages
from meshwright.llm.textvec import mix

from .conftest import prose


def brute_force(rows, least):
    texts = {d: t.split() for d, t in rows}
    seen = Counter(tuple(w[i : i + least]) for w in texts.values() for i in range(len(w) - least + 1))
    out = set()
    for d, w in texts.items():
        hit = [False] * len(w)
        for i in range(len(w) - least + 1):
            if seen[tuple(w[i : i + least])] > 1:
                hit[i : i + least] = [True] * least
        start = None
        for i, v in enumerate([*hit, False]):
            if v and start is None:
                start = i
            elif not v and start is not None:
                out.add((d, start, i))
                start = None
    return out


def corpus(seed):
    rng = random.Random(seed)
    passages = [prose(rng, rng.choice([49, 50, 51, 60, 120, 200])) for _ in range(12)]
    rows = []
    for d in range(60):
        parts = [prose(rng, rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), prose(rng, rng.randrange(0, 60))]
        rows.append((d, " ".join(p for p in parts if p)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, " ".join(["again"] * 130)), (103, " ".join(["a b c"] * 40)), (104, rows[5][1] + " " + rows[5][1])]
    return rows


@pytest.mark.parametrize("block", [1 << 19, 200])
def test_intervals_are_those_of_brute_force(documents, block):
    rows = corpus(block % 7)
    got = {tuple(r) for r in repeated_passages(documents(rows), block=block).collect()}
    assert got == brute_force(rows, 50)


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_anchors_give_the_same(documents, hot):
    rows = corpus(4)
    got = {tuple(r) for r in repeated_passages(documents(rows), hot=hot).collect()}
    assert got == brute_force(rows, 50)


def test_licence_in_many_documents(documents):
    # the text before and behind differs everywhere, so no surroundings at its ends are equal
    rng = random.Random(8)
    licence = " ".join(f"term{i}" for i in range(120))
    rows = [(i, f"{prose(rng, 30, 5)} {licence} {prose(rng, 30, 5)}") for i in range(3000)]
    want = brute_force(rows, 50)
    assert {tuple(r) for r in repeated_passages(documents(rows), hot=1000).collect()} == want
    assert {tuple(r) for r in repeated_passages(documents(rows)).collect()} == want


def test_long_passages(documents):
    rng = random.Random(6)
    passage = prose(rng, 700)
    rows = [(i, f"{prose(rng, 40 + i)} {passage} {prose(rng, 40)}") for i in range(4)] + [(9, passage[: len(passage) // 2]), (10, prose(rng, 600))]
    want = brute_force(rows, 300)
    assert len(want) == 5
    assert {tuple(r) for r in repeated_passages(documents(rows), least=300).collect()} == want
    base = rng.choices(range(50), k=592)
    texts = [np.array(base, np.uint32), np.array([*base[:-1], 77], np.uint32)]
    got = covered(texts, np.zeros(2, np.int64), np.full(2, 292), 300)
    assert got.tolist() == [[0, 591], [0, 591]]


def test_one_hot_anchor_is_indexed_in_parts():
    rng = np.random.default_rng(2)
    core = rng.integers(0, 1000, 30).astype(np.uint32)
    texts = [np.concatenate([rng.integers(0, 3, 25), core, rng.integers(0, 3, 25)]).astype(np.uint32) for _ in range(40)]
    group, anchor = np.zeros(40, np.int64), np.full(40, 30)
    whole, parts = covered(texts, group, anchor, 33), covered(texts, group, anchor, 33, block=400)
    assert (whole == parts).all()
    for i, t in enumerate(texts):
        runs = set()
        for j, u in enumerate(texts):
            if i != j:
                same = t == u
                runs |= {p for s in range(len(t) - 32) if same[s : s + 33].all() for p in range(s, s + 33)}
        assert tuple(whole[i]) == ((min(runs), max(runs) + 1) if runs else (0, 0))


def test_rank():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 37, 500)
    w = WaveletMatrix(x, 37)
    c, i = rng.integers(0, 37, 300), rng.integers(0, 501, 300)
    present = np.isin(c, x)
    assert (w.rank(c, i)[present] == [(x[:b] == a).sum() for a, b in zip(c[present], i[present])]).all()


@pytest.mark.parametrize("seed", range(4))
def test_matching_statistics(seed):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(8)]
    width = max(map(len, texts))
    index = Index(np.concatenate([np.append(t, 0) for t in texts]), 4, width + 1)
    rows = np.zeros((8, width), np.int64)
    for i, t in enumerate(texts):
        rows[i, : len(t)] = t
    ms = index.matching(rows, 2)

    def count(p):
        return sum((u[i : i + len(p)] == p).all() for u in texts for i in range(len(u) - len(p) + 1))

    for i, t in enumerate(texts):
        for j in range(len(t)):
            n = 0
            while j + n < len(t) and count(t[j : j + n + 1]) >= 2:
                n += 1
            assert ms[i, j] == n


def test_every_passage_has_an_anchor_at_the_same_place():
    rng = np.random.default_rng(1)
    h = mix(rng.integers(0, 50, 400).astype(np.uint64))
    passage = mix(np.arange(1000, 1050, dtype=np.uint64))
    a, b = np.concatenate([h[:100], passage, h[100:200]]), np.concatenate([h[200:333], passage, h[333:]])
    first = np.array([0, len(a), len(a) + len(b)])
    at = anchors(grams(np.concatenate([a, b]), 8), first, 8, 50)
    inside = [{int(x - s) for x in at if s <= x <= s + 42} for s in (100, len(a) + 133)]
    assert inside[0] & inside[1]
