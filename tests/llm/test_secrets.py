from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from meshwright.llm.secrets import ALPHABETS, battery, candidates, cuts, infer, secrets, statistics, without_secrets
from meshwright.llm.textvec import string_buffers


def drawn(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_planted_secrets_are_found_and_text_is_left_alone(documents):
    rng = random.Random(4)
    base64url = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    kinds = {"hex": ("0123456789abcdef", 40), "base62": (base64url[:-2], 32), "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 20)}
    rows, planted = [], {}
    for i in range(240):
        alphabet, n = list(kinds.values())[i % 3]
        s = drawn(rng, alphabet, n)
        rows.append((i, f"prefix é {s} suffix"))
        planted[i] = (9, 9 + n, s)
    rows += [(1000 + i, f"AnExampleOfCamelCaseName{i % 7} and release-2024-01-0{i % 9} aaaa1111aaaa1111aaaa 1234567890123456 {'word' * 9}") for i in range(100)]
    got = secrets(documents(rows)).collect()
    found = {r["doc_id"]: (r["start"], r["end"]) for r in got}
    right = sum(found.get(d) == span[:2] for d, span in planted.items())
    assert right >= 0.95 * len(planted)
    assert sum(r["doc_id"] >= 1000 for r in got) <= 0.05 * len(got) + 1


@pytest.mark.parametrize(("alphabet", "encoding", "n"), [("0123456789abcdef", "hex", 18), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base32", 24), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "base64", 44), ("0123456789abcdef", "hex", 513), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "base64", 700)])
def test_p_values_of_random_strings_are_uniform(alphabet, encoding, n):
    rng = random.Random(n)
    p = np.sort([battery(drawn(rng, alphabet, n).encode(), encoding)[-1] for _ in range(400)])
    assert np.abs(p - (np.arange(400) + 0.5) / 400).max() < 0.1


@pytest.mark.parametrize("text", ["AnExampleOfCamelCaseIdentifierName", "aaaaaaaaaaaaaaaa11111111", "abababababababab0101", "SOMEVERYLOUDWORDSHERE", "my-blog-post-about-cats-2024"])
def test_other_strings_are_rejected(text):
    assert battery(text.encode(), infer(text.encode()))[-1] < 0.02


def test_inference():
    assert [infer(x.encode()) for x in ("deadbeef01", "DEADBEEF01", "ABCDEFG234", "XYZ189", "abc189xyz", "aB1", "aB+/", "aB-_", "lowercase", "12345")] == ["hex", "HEX", "base32", "BASE36", "base36", "base62", "base64", "base64url", None, None]


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def plain_statistics(token, encoding):
    """Each test by its formula, a symbol at a time."""
    symbols = ALPHABETS[encoding].decode()
    a, n = len(symbols), len(token)

    def upper(x, mean, variance):
        v = variance / (9 * mean**2)
        return tail(((x / mean) ** (1 / 3) - (1 - v)) / v**0.5)

    chi = sum((token.count(s) - n / a) ** 2 / (n / a) for s in symbols)
    classes = {}
    for s in symbols:
        classes.setdefault("u" if s.isupper() else "l" if s.islower() else "d" if s.isdigit() else "o", []).append(s)
    by_class = sum((sum(token.count(s) for s in c) - n * len(c) / a) ** 2 / (n * len(c) / a) for c in classes.values())
    x = [symbols.index(s) for s in token]
    high = [v >= a // 2 for v in x]
    n1, n2 = sum(high), n - sum(high)
    runs = 1 + sum(p != q for p, q in zip(high, high[1:]))
    mean = 2 * n1 * n2 / n + 1
    variance = 2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1))
    p_runs = 2 * tail(max(0, abs(runs - mean) - 0.5) / variance**0.5) if n1 and n2 else 2.0 ** (1 - n)
    y = [v - (a - 1) / 2 for v in x]
    serial = sum(p * q for p, q in zip(y, y[1:])) / ((a * a - 1) / 12 * (n - 1) ** 0.5)
    return [upper(chi, a - 1, 2 * (a - 1) * (1 - 1 / n)), upper(by_class, len(classes) - 1, 2 * (len(classes) - 1)), min(1, p_runs), 2 * tail(abs(serial))]


@pytest.mark.parametrize("encoding", sorted(ALPHABETS))
def test_statistics_are_the_plain_formulas(encoding):
    rng = random.Random(encoding)
    symbols = ALPHABETS[encoding].decode()
    for n in (16, 25, 64, 200):
        tokens = [drawn(rng, symbols, n) for _ in range(5)] + [drawn(rng, symbols[: len(symbols) // 2 + 2], n), (symbols[0] * (n - 3) + symbols[-1] * 3)]
        got = statistics(np.array([[symbols.index(c) for c in t] for t in tokens]), encoding)
        want = np.array([plain_statistics(t, encoding) for t in tokens])
        assert np.allclose(got, np.clip(want, 1e-300, 1), rtol=1e-6, atol=1e-12)


def test_few_strings_fail_closed():
    bins = np.zeros(200)
    bins[2] = 3  # three strings of p about 0.01
    assert cuts({("hex", 32): bins}, 0.05, 1e-3)[("hex", 32)] >= 0.05
    # neighbours in length tell what to expect, strings of another alphabet don't; the level has to be passed in either case
    near, odd = np.full(200, 20.0), np.zeros(200)
    odd[:10] = 400
    got = cuts({("hex", 32): bins, ("hex", 40): near, ("base62", 32): bins, ("base62", 40): odd}, 0.05, 1e-3)
    assert got[("hex", 40)] < 0.05 <= got[("hex", 32)] and got[("base62", 32)] == got[("base62", 40)] == 2.0


def test_a_stratum_of_other_strings_beside_one_of_secrets_stays_closed():
    words, random_ = np.zeros(200), np.full(200, 2.0)
    words[:6] = 10
    got = cuts({("base32", 16): words, ("base32", 20): random_}, 0.05, 1e-3)
    assert got[("base32", 16)] == 2.0 and got[("base32", 20)] < 0.05


def test_the_best_of_other_strings_are_not_let_in():
    words = np.zeros(200)
    words[:20] = [5, 3, 3, 2, 1, 1, 0, 1, 0, 0, 1, 0, 1, 0, 0, 0, 0, 1, 0, 0]
    cut = cuts({("base32", 16): words}, 0.05, 1e-3)[("base32", 16)]
    assert words[np.arange(200) / 200 >= cut].sum() <= 1  # a lone one can't be told from a secret
    lone = np.zeros(200)
    lone[40] = 1
    assert cuts({("hex", 32): lone}, 0.05, 1e-3)[("hex", 32)] == 0.05


def test_shorter_runs_on_demand(documents):
    rng = random.Random(3)
    rows = [(i, f"pin {drawn(rng, '0123456789abcdef', 12)} end") for i in range(200)]
    assert secrets(documents(rows)).count() == 0
    assert secrets(documents(rows), shortest=12).count() >= 150


def test_masking_leaves_everything_else(documents):
    rng = random.Random(6)
    keys = [drawn(rng, "0123456789abcdef", 40) for _ in range(150)]
    rows = [(i, f"é a{' ' * (i % 3)}{k}, and {k}!") for i, k in enumerate(keys)] + [(500, None), (501, "")]
    spans = {}
    for r in secrets(documents(rows)).collect():
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    want = {}
    for d, t in rows:
        for a, b in sorted(spans.get(d, []), reverse=True):
            t = t[:a] + "[SECRET]" + t[b:]
        want[d] = t
    assert {r["doc_id"]: r["text"] for r in without_secrets(documents(rows)).collect()} == want and len(spans) >= 140


def test_candidates_never_cross_documents():
    raw, offsets = string_buffers(pa.array(["x" * 10 + "1", "y2" * 5, "é" + "z3" * 8 + "!"]))
    assert list(candidates(raw, offsets)) == [(2, 23, 39)]


def test_tokens_in_mixed_runs_are_found(documents):
    rng = random.Random(8)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(i, f"see my-service/{drawn(rng, base62, 40)} there") for i in range(120)]
    found = {(r["doc_id"], r["start"], r["end"]) for r in secrets(documents(rows)).collect()}
    assert sum((i, 15, 55) in found for i, _ in rows) >= 0.95 * len(rows)


def test_cut_controls_the_share_of_other_strings():
    rng = np.random.default_rng(0)
    random_, other = rng.random(4000), np.minimum(rng.exponential(0.03, 6000), 0.999)
    bins = np.bincount((np.concatenate([random_, other]) * 200).astype(int), minlength=200).astype(float)
    cut = cuts({("hex", 32): bins}, 0.05, 1e-3)[("hex", 32)]
    accepted_other, accepted = (other >= cut).sum(), (other >= cut).sum() + (random_ >= cut).sum()
    assert accepted_other / accepted < 0.07 and (random_ >= cut).mean() > 0.8
