from __future__ import annotations

import random

import numpy as np

from meshwright.llm.neardup import Cell, circulant_minhash, jaccard, near_duplicates, shingle_sets, without_near_duplicates
from meshwright.llm.textvec import mix, string_buffers

from .conftest import prose


def edited(rng, text, share):
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def corpus(seed=3):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(20, 300))) for i in range(60)]
    for base in range(0, 30):
        for _ in range(rng.choice([1, 1, 2, 6])):
            rows.append((len(rows), edited(rng, rows[base][1], rng.choice([0.0, 0.02, 0.05, 0.1]))))
    rng.shuffle(rows)
    return rows


def brute_force(rows, k=3, threshold=0.5):
    import pyarrow as pa

    sets = shingle_sets(*string_buffers(pa.array([t for _, t in rows])), k)
    ids = [d for d, _ in rows]
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = 0
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= threshold:
                pairs += 1
                a, b = root(ids[i]), root(ids[j])
                parent[max(a, b)] = min(a, b)
    return {d: root(d) for d in ids}, pairs


def test_groups_are_those_of_all_pairs(documents):
    rows = corpus()
    want, pairs = brute_force(rows)
    got = {r["doc_id"]: r["group_id"] for r in near_duplicates(documents(rows)).collect()}
    assert pairs > 50 and got.keys() == want.keys()
    assert sum(got[d] == want[d] for d in want) >= 0.98 * len(want)


def test_large_group_and_exact_copies(documents):
    rng = random.Random(1)
    base = prose(rng, 200)
    rows = [(i, base) for i in range(200)] + [(200 + i, edited(rng, base, 0.02)) for i in range(200)] + [(1000 + i, prose(rng, 200)) for i in range(20)]
    got = near_duplicates(documents(rows)).collect()
    assert {r["group_id"] for r in got if r["doc_id"] < 1000} == {0}
    assert sum(r["kept"] for r in got) == 21


def test_components_in_parts(documents):
    rng = random.Random(7)
    rows = []
    for g in range(6):
        base = prose(rng, 150)
        rows += [(1000 * g + i, edited(rng, base, 0.03)) for i in range(40)]
    whole = {r["doc_id"]: r["group_id"] for r in near_duplicates(documents(rows)).collect()}
    parts = {r["doc_id"]: r["group_id"] for r in near_duplicates(documents(rows), cell=7).collect()}
    assert whole == parts == {d: d // 1000 * 1000 for d, _ in rows}


def test_chain_across_parts_is_one_group(documents):
    # each document is near the next one alone, so most links have no end at the first document
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 40])) for i in range(50)]
    want, _ = brute_force(rows)
    assert set(want.values()) == {0}
    for cell in (3, 20, 2048):
        got = {r["doc_id"]: r["group_id"] for r in near_duplicates(documents(rows), cell=cell).collect()}
        assert got == want


def test_partners_apart_in_crowded_buckets(documents):
    # 600 documents share a passage that is a quarter of each; the two that are mostly that passage have other ids below and
    # between them in both buckets that they share (by this seed, of 32 bands of four)
    rng = random.Random(27)
    own = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    hot = " ".join(f"hot{i}" for i in range(62))
    rows = [(2 * i, f"{hot} {own(190)}") for i in range(600)] + [(601, f"{hot} {own(24)}"), (4000, f"{hot} {own(24)}")]
    want, pairs = brute_force(rows)
    got = {r["doc_id"]: r["group_id"] for r in near_duplicates(documents(rows), rows=4).collect()}
    assert pairs == 1 and got == want


def test_crowded_bucket_is_brute_force_at_every_setting(documents):
    # one band of three rows, so that nearly all of what is near has to be found in one crowded bucket
    rng = random.Random(5)
    own = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    hot = " ".join(f"hot{i}" for i in range(60))
    rows = [(i, f"{hot} {own(rng.choice([10, 20, 40, 70]))}") for i in range(150)]
    rows += [(200 + i, edited(rng, rows[i][1], 0.05)) for i in range(0, 150, 5)]
    want, pairs = brute_force(rows)
    assert pairs > 50 and 10 < len(set(want.values())) < 150
    got = [{r["doc_id"]: r["group_id"] for r in near_duplicates(documents(rows), cell=cell).collect()} for cell in (5, 64, 2048)]
    assert got[0] == got[1] == got[2] == want


def test_recall_at_the_threshold():
    """Share of pairs just above the threshold that a band proposes, for the default bands."""
    rng, found, total = np.random.default_rng(3), 0, 0
    for seed in range(5):
        base = rng.integers(0, 2**63, (400, 200)).astype(np.uint64)
        other = base.copy()
        other[:, :66] = rng.integers(0, 2**63, (400, 66))  # 134 of 266 in common
        begin = np.arange(0, 400 * 200 + 1, 200)
        a, b = (circulant_minhash(x.ravel(), begin, 128, seed)[:, :126].reshape(400, 3, 42) for x in (base, other))
        found += int((a == b).all(axis=1).any(axis=1).sum())
        total += 400
    assert found / total > 0.98


def test_very_long_texts_fill_the_universe(documents):
    # a million words; unlike ones are candidates of one another and stay apart, near ones are one group
    long = lambda seed: " ".join(map(str, np.random.default_rng(seed).integers(0, 10**6, 10**6)))
    one, two = long(1), long(2)
    rows = [(1, one), (2, two), (3, one[: len(one) * 3 // 4]), (4, "short text of a few words")]
    got = {r["doc_id"]: r["group_id"] for r in near_duplicates(documents(rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}


def test_doc_of_several_texts(documents):
    rng = random.Random(9)
    a, b = prose(rng, 80), prose(rng, 80)
    rows = [(1, a), (5, a), (5, b), (7, b), (8, edited(rng, b, 0.03)), (9, prose(rng, 80))]
    got = {r["doc_id"]: r["group_id"] for r in near_duplicates(documents(rows)).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 8: 1, 9: 9}


def test_rows_that_differ_in_one_column_stay(documents):
    rows = [(1, "some text", "a"), (1, "some text", "a"), (1, "some text", "b"), (None, "x y"), (None, "x y"), (2, "some text", "c")]
    got = sorted(((r["doc_id"], r["source"]) for r in without_near_duplicates(documents(rows)).collect()), key=str)
    assert got == [(1, "a"), (1, "b"), (None, "a"), (None, "a")]


def test_chain_joins_through_the_middle():
    a, b, c = np.arange(0, 60), np.arange(20, 80), np.arange(40, 100)
    g = Cell(0.5)
    for doc, own in ((1, c), (2, b), (3, a)):
        g.add(doc, own)
    assert [g.joins(1, 3), g.joins(1, 2), g.joins(2, 3), g.joins(1, 3)] == [False, True, True, False]


def test_collision_rate_is_jaccard():
    for share in (0.2, 0.5, 0.8):
        n = 1000
        both = int(n * share)
        x = mix(np.arange(2 * n - both).astype(np.uint64))
        a, b = x[:n], np.concatenate([x[:both], x[n:]])
        want = both / (2 * n - both)
        rates = []
        for seed in range(8):
            sig = circulant_minhash(np.concatenate([a, b]), np.array([0, n, 2 * n]), 128, seed)
            rates.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(rates) - want) < 0.04


def test_blocks_dont_matter():
    h = mix(np.arange(5000).astype(np.uint64))
    begin = np.array([0, 10, 10, 4000, 5000])
    assert (circulant_minhash(h, begin, 16, 1, block=7) == circulant_minhash(h, begin, 16, 1)).all()
