from __future__ import annotations

import random

import numpy as np

import pyarrow as pa

from meshwright.llm.textvec import string_buffers
from meshwright.llm.toxicity import STEMS, Lexicon, Members, _company, _pairs, best_threshold, induce, polarity, terms, toxicity, without_toxic

from .conftest import prose

BAD = ["vilest", "rotter", "scurvy", "gormless", "blighter"]


def corpus(seed=1, n=500):
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        w = prose(rng, rng.randrange(60, 250), 200).split()
        truth[i] = rng.random() < 0.2
        if truth[i]:
            for _ in range(max(3, len(w) // 20)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) if rng.random() < 0.6 else "snarl" + rng.choice(["ed", "ing", "y", "fulness", "ish", "o"]))
        rows.append((i, " ".join(w)))
    return rows, truth


def test_held_out_accuracy(spark, documents):
    rows, truth = corpus()
    labels = spark.createDataFrame([(d, 1, int(v)) for d, v in truth.items() if d % 2], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    lex = induce(docs, labels)
    assert set(BAD) <= set(lex.names) and any(n.startswith("snarl") for n in lex.names)
    got = {r["doc_id"]: r["toxic"] for r in toxicity(docs, labels).collect()}
    held = [d for d in truth if d % 2 == 0]
    caught = sum(got[d] for d in held if truth[d]) / sum(truth[d] for d in held)
    wrong = sum(got[d] for d in held if not truth[d]) / sum(not truth[d] for d in held)
    assert caught >= 0.95 and wrong <= 0.03
    kept = {r["doc_id"] for r in without_toxic(docs, labels).collect()}
    assert kept == {d for d, v in got.items() if not v}


def plain_passages(texts, passage):
    """The set of term hashes of every passage, a word at a time."""
    out = []
    for text in texts:
        raw, offsets = string_buffers(pa.array([text]))
        first, h, owner, _, _ = terms(raw, offsets)
        by = {}
        for a, w in zip(h.tolist(), owner.tolist()):
            by.setdefault(w // passage, set()).add(a)
        out += [by[i] for i in sorted(by)]
    return out


def batches(texts):
    yield from (pa.RecordBatch.from_arrays([pa.array(texts[i : i + 7], pa.string())], names=["t"]) for i in range(0, len(texts), 7))


def test_company_counts_are_brute_force():
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(0, 60), 90).replace("w", rng.choice(["word", "w", "sürname"])) for _ in range(40)] + ["", None]
    passages = plain_passages([t or "" for t in texts], 8)
    every = sorted(set().union(*passages))
    seeds = np.array(rng.sample(every, 6), np.uint64)
    families = np.array([3, 3, 64 + 5, 7, 1, 200], np.uint64)
    want = {}
    for p in passages:
        bits = 0
        for s, f in zip(seeds.tolist(), families.tolist()):
            bits |= (1 << f % 64) if s in p else 0
        for t in [*p, 0]:
            n, m, kinds = want.get(t, (0, 0, 0))
            want[t] = (n + 1, m + (bits > 0), kinds | (bits if t else 0))
    got = {}
    for b in _company(seeds, families, 8)(batches(texts)):
        for h, n, m, kinds in zip(*(b.column(i).to_numpy().astype(np.int64).view(np.uint64).tolist() for i in range(4))):
            a = got.get(h, (0, 0, 0))
            got[h] = (a[0] + n, a[1] + m, a[2] | kinds)
    assert got == want


def test_pair_counts_are_brute_force():
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(0, 60), 40) for _ in range(40)] + ["", None]
    passages = plain_passages([t or "" for t in texts], 8)
    nodes = np.array(rng.sample(sorted(set().union(*passages)), 12), np.uint64)
    for core in (0, 5, 12):
        want = {(-1, -1): len(passages)}
        for p in passages:
            own = [i for i, h in enumerate(nodes.tolist()) if h in p]
            for x in own:
                for y in own:
                    if x <= y:
                        want[x, y] = want.get((x, y), 0) + 1
        got, names = {}, {}
        for b in _pairs(nodes, core, 8)(batches(texts)):
            for x, y, n, term in zip(*(b.column(i).to_pylist() for i in range(4))):
                got[x, y] = got.get((x, y), 0) + n
                if term is not None:
                    names[x] = term
        assert got == want and names.keys() == set(range(12))


def test_copies_of_one_document_teach_nothing(spark, documents):
    """Words that a much copied clean document shares with one toxic word stay clean."""
    rows, truth = corpus(n=400)
    rng = random.Random(11)
    odd = prose(rng, 80, 10**6) + " vilest " + prose(rng, 60, 10**6)
    for i in range(120):
        w = odd.split()
        w[rng.randrange(60)] = f"edit{i}"
        rows.append((1000 + i, " ".join(w)))
        truth[1000 + i] = False
    labels = spark.createDataFrame([(d, 1, int(v)) for d, v in truth.items() if d < 1000], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in toxicity(documents(rows), labels).collect()}
    assert sum(got[d] for d in got if d >= 1000) == 0
    assert sum(got[d] for d in truth if truth[d]) >= 0.95 * sum(truth.values())


def test_without_labels_nothing_is_toxic(spark, documents):
    rows, _ = corpus(n=30)
    for own in ([], [(1, 1, 0)], [(1, 1, 1)], [(None, 1, 1), (3, 1, None)]):
        got = toxicity(documents(rows), spark.createDataFrame(own, "doc_id long, quality int, toxic int")).collect()
        assert len(got) == 30 and not any(r["toxic"] or r["score"] for r in got)


def test_walk_reaches_company_of_the_seeds():
    # 0-1-2 hang together, as do 3-4-5; a weak edge joins them
    x, y, w = np.array([0, 1, 0, 3, 4, 3, 2]), np.array([1, 2, 2, 4, 5, 5, 3]), np.array([2.0, 2, 2, 2, 2, 2, 0.1])
    share = polarity(7, x, y, w, np.array([0]), np.array([5]))
    assert share[:3].min() > 0.75 and share[3:6].max() < 0.25 and share[6] == 0.5


def test_terms_are_words_and_stems():
    raw, offsets = string_buffers(pa.array(["chónos ab", "", "été"]))
    first, h, owner, begin, end = terms(raw, offsets)
    spelled = sorted((int(o), raw[a:b].tobytes().decode()) for o, a, b in zip(owner, begin, end))
    assert first.tolist() == [0, 2, 2, 3] and len(set(h.tolist())) == len(h)
    assert spelled == [(0, "chón"), (0, "chóno"), (0, "chónos"), (1, "ab"), (2, "été")] and STEMS == (4, 5, 6)


def test_members():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    m = Members(h[::7])
    at, place = m.find(h)
    assert at.tolist() == list(range(0, 1000, 7)) and (m.table[place] == h[at]).all()
    assert len(Members(h[:0]).find(h)[0]) == 0


def test_threshold():
    score, toxic = np.array([0.0, 0.1, 0.2, 0.5, 0.6]), np.array([False, False, False, True, True])
    assert best_threshold(score, toxic) == 0.35
    assert best_threshold(np.zeros(3), np.array([True, False, True])) == float("inf") == Lexicon().threshold
