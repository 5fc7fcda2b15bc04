from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshwright.llm.packing import best_fit, fillings, lower_bound, pack, packs

from .conftest import prose


def optimum(sizes, capacity):
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        tried = set()
        for j, b in enumerate(bins):
            if b + sizes[i] <= capacity and b not in tried:
                tried.add(b)
                bins[j] += sizes[i]
                place(i + 1, bins)
                bins[j] -= sizes[i]
        bins.append(sizes[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best[0] if sizes else 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=11))
def test_search_is_optimal(sizes):
    bins = pack(sizes, 60, 10**6)
    assert sorted(s for b in bins for s in b) == sorted(sizes) and all(sum(b) <= 60 for b in bins)
    assert len(bins) == optimum(sizes, 60) >= lower_bound(sizes, 60)


def test_search_beats_best_fit():
    rng, better = random.Random(0), 0
    for _ in range(25):
        sizes = []
        for _ in range(6):
            a = rng.randint(26, 40)
            b = rng.randint(26, 74 - a)
            sizes += [a, b, 100 - a - b]
        bins = pack(sizes, 100, 10**6)
        assert len(bins) == 6
        better += len(best_fit(sizes, 100)) > 6
    assert better > 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=11))
def test_search_is_optimal_by_default(sizes):
    assert len(pack(sizes, 60)) == optimum(sizes, 60)


def plain_fillings(room, sizes):
    """All undominated sets, by trying all replacements of all subsets."""
    sets = {tuple(sorted(c)) for n in range(len(sizes) + 1) for c in combinations(sizes, n) if sum(c) <= room}

    def dominated(chosen):
        rest = Counter(sizes) - Counter(chosen)
        for n in range(len(chosen) + 1):
            for out in set(combinations(chosen, n)):
                if any(sum(out) <= c <= sum(out) + room - sum(chosen) and out != (c,) for c in rest):
                    return True
        return False

    return sorted(c for c in sets if not dominated(c))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=7), st.integers(0, 25), st.integers(0, 25))
def test_fillings_are_those_of_brute_force(sizes, room, slack):
    counts = Counter(sizes)
    got = [tuple(sorted(f)) for f in fillings(room, sorted(counts), counts, [10**6])]
    assert [sum(f) for f in got] == sorted(map(sum, got), reverse=True)
    assert sorted(got) == plain_fillings(room, sizes)
    assert sorted(tuple(sorted(f)) for f in fillings(room, sorted(counts), counts, [10**6], slack)) == [f for f in plain_fillings(room, sizes) if sum(f) >= room - slack]


def exact_triples(rng, n, capacity):
    sizes = []
    for _ in range(n):
        a = rng.randint(capacity * 26 // 100, capacity * 40 // 100)
        b = rng.randint(capacity * 26 // 100, capacity * 74 // 100 - a)
        sizes += [a, b, capacity - a - b]
    return sizes


def test_default_search_on_exact_triples():
    rng = random.Random(1)
    sizes = exact_triples(rng, 60, 100)
    assert len(best_fit(sizes, 100)) > 60 == len(pack(sizes, 100))
    # at 2048 tokens exact sums are rarer: one sequence more than the least
    sizes = exact_triples(rng, 60, 2048)
    assert len(best_fit(sizes, 2048)) > 64 and len(pack(sizes, 2048)) <= 61
    sizes = exact_triples(rng, 200, 2048) + [1] * 800
    assert len(best_fit(sizes, 2048)) > 215 and len(pack(sizes, 2048)) <= 203


def test_many_small_documents(documents):
    sizes = [843] * 27 + [799] * 22 + [1] * 1392
    bins = pack(sizes, 2048)
    assert sorted(s for b in bins for s in b) == sorted(sizes) and all(sum(b) <= 2048 for b in bins) and len(bins) == 25
    got = packs(documents([(i, " ".join(["w"] * n)) for i, n in enumerate(sizes)])).collect()
    assert len(got) == 25 and sum(r["n_tokens"] for r in got) == sum(sizes)
    assert len(pack([1] * 30_000 + [2] * 9_000, 8192)) == 6


def test_fillings_are_undominated():
    asc, counts = [2, 3, 5, 8], {2: 1, 3: 1, 5: 1, 8: 1}
    got = sorted(sorted(f) for f in fillings(8, asc, counts, [10**6]))
    assert got == [[8]]  # 3 + 5 gives way to 8
    assert list(fillings(1, asc, counts, [10**6])) == [[]]


def test_budget_ends_the_search():
    rng = random.Random(1)
    sizes = [rng.randint(300, 1000) for _ in range(2000)]
    assert len(pack(sizes, 2048, 5000)) <= len(best_fit(sizes, 2048))


@pytest.mark.parametrize("block", [7, 4096])
def test_every_token_is_in_one_pack(documents, block):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.choice([0, 1, 5, 64, 100, 128, 129, 400]))) for i in range(120)] + [(None, "a b c"), (5, "again a row"), (200, None)]
    got = packs(documents(rows), capacity=128, block=block).collect()
    assert len({r["pack_id"] for r in got}) == len(got)
    assert all(r["n_tokens"] == sum(p["n_tokens"] for p in r["pieces"]) <= 128 for r in got)
    seen = sorted(((p["doc_id"] is None, p["doc_id"] or 0, p["start"], p["n_tokens"]) for r in got for p in r["pieces"]))
    want = []
    for d, t in rows:
        n = len((t or "").split())
        want += [(d is None, d or 0, a, min(128, n - a)) for a in range(0, n, 128)]
    assert seen == sorted(want)
