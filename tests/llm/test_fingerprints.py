from __future__ import annotations

import numpy as np
import pyarrow as pa

from meshwright.llm.fingerprints import bags, fingerprints, signatures, variates
from meshwright.llm.textvec import mix, string_buffers, words


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(0)
    h = mix(np.arange(1, 400, dtype=np.uint64))
    for t in range(4):
        w1 = rng.integers(0, 6, len(h))
        w2 = np.where(rng.random(len(h)) < 0.3 * t, rng.integers(0, 6, len(h)), w1)
        want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
        both, first = np.concatenate([np.repeat(h, w1), np.repeat(h, w2)]), np.array([0, w1.sum(), w1.sum() + w2.sum()])
        rates = []
        for seed in range(4):
            s, some = signatures(both, first, 1024, seed)
            assert some.tolist() == [0, 1]
            rates.append((s[0] == s[1]).mean())
        assert abs(np.mean(rates) - want) < 0.03


def plain_signature(text, width, seed):
    """The definition, a word and a coordinate at a time: (ln a, sample) of every word, the least of each coordinate."""
    raw, offsets = string_buffers(pa.array([text]))
    h, _ = words(raw, offsets)
    r, _, ln_c, b = (v[:, 0] for v in variates(1, seed))
    out = []
    for j in range(width):
        best = None
        for word in sorted(set(h.tolist())):
            weight = h.tolist().count(word)
            at = [((word >> s & 0xFFFF) + j) % len(r) for s in (0, 16, 32)]
            t = np.floor(np.log(np.float32(weight)) * (np.float32(1) / r[at[0]]) + b[at[2]])
            ln_a = ln_c[at[1]] - r[at[0]] * (t - b[at[2]] + np.float32(1))
            if best is None or ln_a < best[0]:
                best = (ln_a, word, int(t))
        out.append(best)
    return out


def test_signature_is_the_plain_one():
    rng = np.random.default_rng(6)
    vocabulary = [f"v{i}" for i in range(50)]
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (1, 2, 30, 200, 200)] + ["same same same", "same"]
    plain = [plain_signature(t, 64, 3) for t in texts]
    h, first = words(*string_buffers(pa.array(texts)))
    got, some = signatures(h, first, 64, 3)
    assert some.tolist() == list(range(len(texts)))
    # samples are names of (word, t): they agree between two documents where, and only where, the plain ones do
    for x in range(len(texts)):
        for y in range(x):
            want = np.array([p[1:] == q[1:] for p, q in zip(plain[x], plain[y])])
            assert ((got[x] == got[y]) == want).mean() > 0.98  # single precision may turn a floor


def test_order_and_blocks_dont_matter():
    raw, offsets = string_buffers(pa.array(["a b a c", "c a b a", "", "a b c", " ".join(f"w{i}" for i in range(300))]))
    h, first = words(raw, offsets)
    s, some = signatures(h, first, 64, 1)
    assert some.tolist() == [0, 1, 3, 4] and (s[0] == s[1]).all() and (s[0] != s[3]).any()
    assert (signatures(h, first, 64, 1, block=9)[0][some] == s[some]).all()
    terms, counts, begin = bags(h, first)
    assert counts[begin[0] : begin[1]].tolist().count(2) == 1 and len(terms) == begin[-1]


def test_rows(documents):
    got = {r["doc_id"]: r for r in fingerprints(documents([(1, "x y"), (2, None), (3, "y x"), (4, "")])).collect()}
    assert got[1]["signature"] == got[3]["signature"] and len(got[1]["signature"]) == 64
    assert got[2]["signature"] is None and got[4]["signature"] is None and got[4]["n_words"] == 0
