from __future__ import annotations

import random

import numpy as np
import pytest

from meshwright.llm.pii import classify, luhn, pii, reliabilities, spans

from .conftest import prose


def card(rng):
    d = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    return next(d + str(c) for c in range(10) if luhn(d + str(c)))


def span(rng, kind):
    return {
        "email": lambda: f"ann.{rng.randrange(100)}@mail{rng.randrange(9)}.example.com",
        "ip": lambda: f"{rng.randrange(1, 120)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}",
        "phone": lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}",
        "card": lambda: card(rng),
    }[kind]()


def test_planted_spans_are_found_and_others_left_alone(documents):
    rng = random.Random(0)
    rows, truth, decoys = [], {}, set()
    for i in range(400):
        a, b = prose(rng, 20).replace("w", "é"), prose(rng, 20)
        a, b = "".join(c for c in a if not c.isdigit()), "".join(c for c in b if not c.isdigit())
        if i % 2:
            kind = ("email", "ip", "phone", "card")[i // 2 % 4]
            s = span(rng, kind)
            truth[i] = (len(a) + 1, len(a) + 1 + len(s), kind)
        else:
            s = rng.choice(["999.999.999.999", "2021-03-04", "4111111111111119", "version 0.0.0.0", "0000000000000000", "1999 2001"])
            decoys.add(i)
        rows.append((i, f"{a} {s} {b}"))
    got = pii(documents(rows)).collect()
    found = {r["doc_id"]: (r["start"], r["end"], r["kind"]) for r in got}
    assert sum(found.get(d) == v for d, v in truth.items()) >= 0.97 * len(truth)
    assert sum(d in found for d in decoys) <= 0.05 * len(decoys)


def test_em_finds_the_bad_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    right = [0.95, 0.9, 0.85, 0.55]
    votes = np.stack([np.where(rng.random(4000) < r, truth, ~truth) * 2 - 1 for r in right], axis=1)
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    table, share, post = reliabilities(patterns, counts.astype(float))
    assert abs(share - 0.4) < 0.04
    measured = [table[i, 1, 2] / (table[i, 1, 0] + table[i, 1, 2]) for i in range(4)]
    assert measured[0] > measured[1] > measured[2] > measured[3] and measured[3] < 0.65
    guess = (post > 0.5)[back.ravel()]
    assert (guess == truth).mean() > max(0.9, ((votes.sum(axis=1) > 0) == truth).mean())


def plain_em(rows, rounds=300, vetoes=0):
    """The same model, a candidate at a time."""
    n, labelers = len(rows), len(rows[0])
    strength = 7 + 0.2 * n
    prior = [[[strength * v for v in side] for side in ([[0.6, 0.3, 0.1], [0.01, 0.19, 0.8]] if i < vetoes else [[0.45, 0.4, 0.15], [0.1, 0.4, 0.5]])] for i in range(labelers)]
    post = [0.1 if any(v < 0 for v in r[:vetoes]) or sum(r) < 0 else 0.9 if sum(r) > 0 else 0.5 for r in rows]
    for _ in range(rounds):
        share = (sum(post) + 1) / (n + 2)
        table = []
        for i in range(labelers):
            sides = []
            for c in (0, 1):
                cells = [prior[i][c][k] + sum((p if c else 1 - p) for r, p in zip(rows, post) if r[i] == k - 1) for k in range(3)]
                cells = [x / sum(cells) for x in cells]
                if c and i < vetoes:
                    cells[0] = min(cells[0], 0.01)
                    cells = [x / sum(cells) for x in cells]
                sides.append(cells)
            table.append(sides)
        post = []
        for r in rows:
            odds = [1 - share, share]
            for c in (0, 1):
                for i, v in enumerate(r):
                    odds[c] *= table[i][c][v + 1]
            post.append(odds[1] / sum(odds))
    return post


@pytest.mark.parametrize("vetoes", [0, 2])
def test_em_over_counts_is_em_over_candidates(vetoes):
    rng = np.random.default_rng(3)
    truth = rng.random(150) < 0.5
    rows = np.where(rng.random((150, 4)) < [0.9, 0.8, 0.7, 0.6], truth[:, None], ~truth[:, None]) * 2 - 1
    rows[rng.random(rows.shape) < 0.3] = 0
    patterns, back, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    post = reliabilities(patterns, counts.astype(float), vetoes, rounds=300)[2]
    assert np.allclose(post[back.ravel()], plain_em(rows.tolist(), vetoes=vetoes), atol=1e-6)


@pytest.mark.parametrize("number", ["GR1601101250000000012300695", "CZ6508000000192000145399", "DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "NO9386011117947", "PL61109010140000071219812874"])
def test_registered_account_numbers_pass(documents, number):
    rows = [(i, f"iban {number} ok") for i in range(20)] + [(50 + i, f"iban {number[:-1]}{(int(number[-1]) + 1) % 10} no") for i in range(20)]
    found = {r["doc_id"] for r in pii(documents(rows)).collect() if r["kind"] == "iban"}
    assert found == set(range(20))


def test_lists_abstain_where_they_are_silent():
    votes = {s[3]: s[4] for t in ("write anna@example.dev now", "account ZZ12 3456 7890 1234 5678") for s in spans(t.encode())}
    assert votes["anna@example.dev"][:3] == [1, 0, 0] and votes["ZZ12 3456 7890 1234 5678"][0] == 0 == votes["ZZ12 3456 7890 1234 5678"][2]


@pytest.mark.parametrize("text", ["0171 2345678", "2125550100", "+49 171 2345678", "030/12345678", "+44 (0) 171 2345678"])
def test_national_numbers_are_found(documents, text):
    got = pii(documents([(i, f"please call {text} today") for i in range(20)])).collect()
    assert len(got) == 20 and {(r["kind"], r["start"], r["end"]) for r in got} == {("phone", 12, 12 + len(text))}


def test_counts_stand_for_rows():
    one = [("card", "+++00", "5200ss", 3), ("card", "--+00", "6300sp", 2)]
    assert classify(one).keys() == {p[:3] for p in one} and classify([]) == {}


@pytest.mark.parametrize(("text", "kinds"), [("mail a@b.org now", ["email"]), ("@@ a@ @b", []), ("DE44 5001 0517 5407 3249 31", ["iban"]), ("078-05-1120", ["ssn"]), ("4111 1111 1111 1111", ["card"]), ("call (212) 555-0100.", ["phone"]), ("1.2.3", []), ("x10.0.0.1", [])])
def test_shapes(text, kinds):
    assert [s[2] for s in spans(text.encode())] == kinds


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("call +1 (826) 555-4081 190.137.223.204 now", [("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204")]),
        ("call (826) 555-4081 10.1.22.33 now", [("phone", "(826) 555-4081"), ("ip", "10.1.22.33")]),
        ("call (826) 555-4081 078-05-1120", [("phone", "(826) 555-4081"), ("ssn", "078-05-1120")]),
        ("(212) 555-0100 (212) 555-0101", [("phone", "(212) 555-0100"), ("phone", "(212) 555-0101")]),
        ("call +1 (826) 555-4081 42 50 people", [("phone", "+1 (826) 555-4081")]),
        ("415-555-2671 190.137.223.204", [("phone", "415-555-2671"), ("ip", "190.137.223.204")]),
        ("call +14155552671 or 4155552671.", [("phone", "+14155552671"), ("phone", "4155552671")]),
    ],
)
def test_adjacent_and_unseparated_numbers(text, want):
    assert [s[2:4] for s in spans(text.encode())] == want


def test_long_runs_take_linear_time():
    import time

    began = time.time()
    for text in (b"a" * 200_000 + b"1", b"1" * 200_000, b"1 " * 100_000, b"a.b-" * 50_000 + b"@", b"1-2." * 50_000):
        list(spans(text))
    assert time.time() - began < 20
