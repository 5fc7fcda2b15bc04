from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.llm import mixing
from meshwright.llm.mixing import Flight, mixed, probabilities, token_count

from .conftest import prose


def test_totals_are_balanced(documents):
    rng = random.Random(2)
    rows = [(i, prose(rng, int(rng.lognormvariate(4, 0.7)) + 1), rng.choice(["hot"] * 6 + ["a", "b", "c"])) for i in range(1500)]
    got = mixed(documents(rows)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1500))
    longest = max(r["n_tokens"] for r in got)
    for s in ("hot", "a", "b", "c"):
        own = [r for r in got if r["source"] == s]
        p = own[0]["probability"]
        assert all(r["probability"] == p for r in own)
        assert abs(sum(r["selected"] for r in own) - p * len(own)) <= 2
        assert abs(sum(r["n_tokens"] * r["selected"] for r in own) - p * sum(r["n_tokens"] for r in own)) <= 2 * longest
    total = sum(r["n_tokens"] for r in got)
    assert abs(sum(r["n_tokens"] * r["selected"] for r in got) - 0.75 * total) <= 3 * longest


def test_token_count(spark):
    texts = [None, "", " ", " \n\t ", "a", " a", "a ", "  a\nb\t\tc  ", "é 東", "x" * 1000 + " y"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", token_count(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == [len((t or "").split()) for t in texts]


def plain_probabilities(tokens, weights, share):
    """One source after the other, from the least of tokens by weight."""
    if not sum(tokens.values()):
        return dict.fromkeys(tokens, share)
    left, out = share * sum(tokens.values()), {s: 1.0 for s in tokens if not tokens[s]}
    order = sorted((s for s in tokens if tokens[s]), key=lambda s: tokens[s] / weights[s] if weights[s] else float("inf"))
    while order:
        scale = left / max(sum(weights[s] for s in order), 1e-300)
        if weights[order[0]] * scale < tokens[order[0]]:
            return out | {s: weights[s] * scale / tokens[s] for s in order}
        out[order[0]] = 1.0
        left -= tokens[order.pop(0)]
    return out


@pytest.mark.parametrize(
    ("tokens", "weights", "share"),
    [
        ({"a": 1000, "b": 100, "c": 100, "none": 0}, {"a": 1, "b": 1, "c": 1, "none": 1}, 0.5),
        ({"a": 0, None: 0}, {"a": 1, None: 1}, 0.5),
        ({}, {}, 0.5),
        ({"a": 10**12, "b": 10**6, "c": 3, None: 500}, {"a": 10**6, "b": 10**3, "c": 2, None: 0}, 0.75),
        ({str(i): i * i + 1 for i in range(200)}, {str(i): (i * i + 1) ** 0.5 for i in range(200)}, 0.9),
        ({"a": 5, "b": 7}, {"a": 1, "b": 1}, 1.0),
    ],
)
def test_probabilities_are_those_of_the_plain_version(spark, tokens, weights, share):
    table = spark.createDataFrame([(s, n, float(weights[s])) for s, n in tokens.items()], "source string, tokens long, weight double")
    got = {r["source"]: r["probability"] for r in probabilities(table, share).collect()}
    assert got == {s: pytest.approx(p, rel=1e-9) for s, p in plain_probabilities(tokens, weights, share).items()}


def test_draw_does_not_follow_partitions(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 100)
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randrange(1, 80)), rng.choice("abcd") + str(rng.randrange(60))) for i in range(900)]
    draws = []
    for n in (1, 5, 16):
        draws.append({r["doc_id"]: r["selected"] for r in mixed(documents(rows).repartition(n)).collect()})
    assert draws[0] == draws[1] == draws[2] and 0.5 < sum(draws[0].values()) / 900 < 0.95
    other = {r["doc_id"]: r["selected"] for r in mixed(documents(rows), seed=7).collect()}
    assert other != draws[0] and other.keys() == draws[0].keys()


def test_flight_keeps_both_equations_and_expectations():
    chosen = np.zeros(30)
    rng = np.random.default_rng(0)
    tokens, state = rng.integers(1, 100, 30), rng.uniform(0.1, 0.9, 30)
    for seed in range(3000):
        f, decided = Flight(random.Random(seed)), []
        for i in range(30):
            decided += f.add(float(tokens[i]), float(state[i]), i)
        now = np.zeros(30)
        for w in decided + f.window:
            now[w[2]] = w[1]
        assert abs(now.sum() - state.sum()) < 1e-6 and abs(now @ tokens - state @ tokens) < 1e-4
        assert len(f.window) <= 2
        for w in f.land():
            now[w[2]] = w[1]
        assert set(now) <= {0.0, 1.0}
        chosen += now
    assert np.abs(chosen / 3000 - state).max() < 0.05


def test_equal_lengths():
    f, out = Flight(random.Random(1)), []
    for i in range(100):
        out += f.add(5.0, 0.3, i)
    out += f.land()
    assert len(out) == 100 and sum(w[1] for w in out) in (29, 30, 31)
