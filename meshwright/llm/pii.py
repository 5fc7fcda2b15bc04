"""Personal data by weak supervision.

Candidates are spans shaped like e-mail, IP address, phone, card, social security
or bank account numbers.  Labelers of three sorts (patterns and check digits,
gazetteers, context) vote on each that it is, isn't, or abstain.  Expectation
maximisation over the counts of all vote patterns estimates every labeler's
reliability for every kind (Dawid and Skene, with a prior that labelers beat
chance and that formats and check digits hardly ever fail the real thing), and its posteriors train the final span classifier, a logistic
regression over votes and further traits of the span.

Both fits see counts of distinct patterns, so they take in every candidate of the
corpus however many there are.

Defined results
---------------
* null and empty texts have no spans; an empty table gives no rows; very long texts
  are searched whole, in linear time;
* context labelers see ``context`` bytes to each side of a span;
* a list that doesn't have an entry abstains, as none is complete;
* repeated rows are reported each; a null doc_id is reported as null;
* spans are in characters and don't overlap: of shapes that fit at one place, the
  first in the order of KINDS counts;
* only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import workers_import, written
from .textvec import chunks, id_column, string_buffers

KINDS = ("email", "iban", "ip", "ssn", "card", "phone")
_SHAPES = re.compile(
    rb"""(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?(?![A-Za-z0-9]))
    |(?P<ip>(?<![A-Za-z0-9.])\d{1,3}(?:\.\d{1,3}){3}(?![A-Za-z0-9]|\.\d))
    |(?P<ssn>(?<![A-Za-z0-9-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9-]))
    |(?P<card>(?<![A-Za-z0-9.+-])\d(?:[ -]?\d){12,18}(?![A-Za-z0-9]|-\d))
    |(?P<phone>(?<![A-Za-z0-9.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![A-Za-z0-9])
        |(?<![A-Za-z0-9.])(?:\+\d{1,3}[ .-]?(?:\(0\)[ ]?)?|0)\d{2,4}[ ./-]\d{5,8}(?![A-Za-z0-9])
        |(?<![A-Za-z0-9.])\+\d{7,15}(?![A-Za-z0-9])|(?<![A-Za-z0-9.+-])[2-9]\d{9}(?![A-Za-z0-9]))""",
    re.X,
)
_SHAPE = {k: re.compile(_SHAPES.pattern[_SHAPES.pattern.index(b"(?P<" + k.encode()) :].split(b"\n    |(?P<")[0], re.X) for k in ("ip", "ssn", "phone")}
_AMERICAN = re.compile(rb"(?:\+1[ .-]?)?\(?[2-9]\d\d\)?[ .-]\d{3}[ .-]\d{4}(?![A-Za-z0-9])")
_GROUP = re.compile(rb"[ .-]\d{2,4}$")
_TOP = frozenset("com org net edu gov int info biz io co de fr es it nl uk eu us ca au ch at be pt br mx jp cn in ru pl se no fi dk ie".split())
_ISSUERS = re.compile(r"4|5[1-5]|2(22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|35(2[89]|[3-8])|6011|64[4-9]|65")
_CALLING = re.compile(r"\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")
_CODES = """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22
    GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28
    NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"""
#: Lengths of account numbers by country, as registered.
_IBAN = {c[:2]: int(c[2:]) for c in _CODES.split()}
_NEAR = {
    "email": rb"e-?mail|contact|correo|courriel|write|kontakt|adresse",
    "iban": rb"iban|account|konto|cuenta|compte|bank",
    "ip": rb"\bip\b|host|server|address|adresse|login",
    "ssn": rb"ssn|social|security",
    "card": rb"card|visa|master|amex|credit|karte|tarjeta|carte",
    "phone": rb"tel|phone|call|mobile|fax|contact|anruf|llam|appel",
}
_NEAR = {k: re.compile(v, re.I) for k, v in _NEAR.items()}
_NUMBERED = re.compile(rb"(version|release|section|chapter|isbn|page|art|no|nr|v)\.?\s*$", re.I)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def luhn(digits: str) -> bool:
    """The check of card numbers."""
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def _format(kind: str, s: str) -> int:
    d = _digits(s)
    if kind == "email":
        return 1 if re.fullmatch(r"[A-Za-z0-9](?:[A-Za-z0-9_%+-]|\.(?!\.))*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}", s) else -1
    if kind == "iban":
        return 0 if s[:2] not in _IBAN else 1 if len(s.replace(" ", "")) == _IBAN[s[:2]] else -1
    if kind == "ip":
        return 1 if all(int(x) < 256 and str(int(x)) == x for x in s.split(".")) else -1
    if kind == "ssn":
        return -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 1
    if kind == "card":
        return 1 if len(d) in (13, 14, 15, 16, 19) else -1
    return 1 if re.fullmatch(r"(\+1[ .-]?)?\(?[2-9]\d\d\)?[ .-]\d{3}[ .-]\d{4}|\+\d{7,15}|[2-9]\d{2}[2-9]\d{6}|\+\d{1,3}([ .-]?\(?\d{1,4}\)?){2,5}|(\+\d{1,3}[ .-]?(\(0\) ?)?|0)\d{2,4}[ ./-]\d{5,8}", s) and 7 <= len(d) <= 15 else -1


def _check(kind: str, s: str) -> int:
    d = _digits(s)
    if kind == "card":
        return 1 if luhn(d) and len(set(d)) > 2 else -1
    if kind == "iban":
        t = s.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1 else -1
    if kind == "phone" and re.fullmatch(r"(19|20)\d\d[.-]\d\d?[.-]\d\d?|\d\d?[.-]\d\d?[.-](19|20)?\d\d|(19|20)\d\d[ .-](19|20)\d\d", s):
        return -1  # a date or years
    return -1 if len(d) > 3 and len(set(d)) < 3 else 0


def _gazetteer(kind: str, s: str) -> int:
    if kind == "email":
        return 1 if s.rsplit(".", 1)[-1].lower() in _TOP else 0  # no list has all
    if kind == "iban":
        return 1 if s[:2] in _IBAN else 0
    if kind == "ip":
        return -1 if re.match(r"0\.|127\.|255\.|22[4-9]\.|2[34]\d\.", s) else 1
    if kind == "card":
        return 1 if _ISSUERS.match(_digits(s)) else -1
    if kind == "phone":
        return 1 if _CALLING.match(s) else (-1 if s[0] == "+" else 0)
    return 0


def _named(kind: str, before: bytes, after: bytes) -> int:
    if _NUMBERED.search(before):
        return -1
    return 1 if _NEAR[kind].search(before) else 0


def _prose(kind: str, before: bytes, after: bytes) -> int:
    if before[-1:] and before[-1:] in b"=\"'/:#&<>{}[]" or after[:1] and after[:1] in b"=\"'/#&<>{}[]":
        return -1
    left, right = before.split()[-1:], after.split()[:1]
    letters = [bool(w) and not any(48 <= c < 58 for c in w[0]) for w in (left, right)]
    return 1 if all(letters) else (-1 if left and right and not any(letters) else 0)


#: Each takes the kind and the span, or the kind and what stands around it.
SPAN_LABELERS: tuple[Callable, ...] = (_format, _check, _gazetteer)
CONTEXT_LABELERS: tuple[Callable, ...] = (_named, _prose)
#: The first labelers, of format and check digits, know what can't be right.
VETOES = 2


def traits(s: str, before: bytes, after: bytes) -> str:
    """Further discrete traits: digits and length in bands, sign, brackets, neighbours."""
    near = lambda c: "s" if not c or c.isspace() else "p" if c in b".,;!?" else "x"
    return f"{min(len(_digits(s)) // 3, 7)}{min(len(s) // 6, 7)}{int(s[0] == '+')}{int('(' in s)}{near(before[-1:])}{near(after[:1])}"


def _other(raw: bytes, a: int, b: int) -> int:
    """Where an address or a social security number begins inside a..b that ends there or later; ``b`` if none does."""
    for kind in ("ip", "ssn"):
        for at in range(a + 1, b):
            m = _SHAPE[kind].match(raw, at)
            if m and m.end() >= b and _format(kind, m.group().decode()) > 0:
                b = at
                break
    return b


def _phone(raw: bytes, a: int, b: int) -> int:
    """Where the phone number at ``a`` ends, of a match up to ``b``; ``a`` if none is there.

    Groups go from the end while another number of fixed shape begins in them or
    the digits are too many; a whole number of the North American shape or with a
    calling code goes before a longer run that has no known shape.
    """
    b = a + len(raw[a : _other(raw, a, b)].rstrip(b" .-"))
    if (m := _AMERICAN.match(raw, a)) and m.end() <= b:
        return m.end()
    ends = [b]
    while (m := _GROUP.search(raw, a, ends[-1])) and m.start() > a:
        ends.append(m.start())
    fit = [e for e in ends if 7 <= len(_digits(raw[a:e].decode())) <= 15]
    return next((e for e in fit if _format("phone", raw[a:e].decode()) > 0), fit[0]) if fit else a


def _matches(raw: bytes) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of shapes; the search goes on where a number ends, or inside what is refused."""
    at = 0
    while m := _SHAPES.search(raw, at):
        kind, (a, b) = m.lastgroup, m.span()
        at = b
        if kind == "card" and _other(raw, a, b) < b and (m := _SHAPE["phone"].match(raw, a)):
            kind, at, b = "phone", m.end(), m.end()
        if kind == "phone":
            b = _phone(raw, a, b)
            if a == b:
                # the next group may begin another number
                inner = re.compile(rb"[ .-]").search(raw, a + 1, at)
                at = inner.end() if inner else at
                continue
            at = b
        yield a, b, kind


def spans(raw: bytes, context: int = 40) -> Iterator[tuple[int, int, str, str, list[int], str]]:
    """(start, end, kind, span, votes, traits) of the candidates of a text."""
    for a, b, kind in _matches(raw):
        s = raw[a:b].decode()
        before, after = raw[max(0, a - context) : a], raw[b : b + context]
        votes = [f(kind, s) for f in SPAN_LABELERS] + [f(kind, before, after) for f in CONTEXT_LABELERS]
        yield a, b, kind, s, votes, traits(s, before, after)


_FOUND = "doc_id long, start long, end long, kind string, votes string, traits string"


def _find(batches: Iterator[pa.RecordBatch], context: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = string_buffers(id_column(batch, "t"))
        ids, rows = id_column(batch, "id"), []
        for i, j in chunks(offsets):
            part, offs = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            hint = np.concatenate([[0], np.cumsum((part == 64) | ((part >= 48) & (part < 58)))])
            for d in np.flatnonzero(hint[offs[1:]] > hint[offs[:-1]]):
                own = part[offs[d] : offs[d + 1]]
                found = list(spans(own.tobytes(), context))
                if found:
                    lead = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                    rows += [(ids[int(i + d)].as_py(), int(lead[a]), int(lead[b]), kind, "".join("-0+"[v + 1] for v in votes), more) for a, b, kind, _, votes, more in found]
        if rows:
            kinds = [pa.int64()] * 3 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _FOUND.split(", ")])


def reliabilities(votes: np.ndarray, counts: np.ndarray, vetoes: int = 0, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over vote patterns (rows of -1, 0, 1) with their counts.

    The prior has labelers right more often than wrong; the first ``vetoes`` of
    them vote against the real thing in one case of a hundred at most.  Returns P(vote | labeler, class) as (labelers, 2, 3), the share of the
    positive class, and every pattern's posterior.
    """
    strength = 7 + 0.2 * counts.sum()  # the prior keeps its say however many candidates there are
    prior = np.repeat(strength * np.array([[[0.45, 0.4, 0.15], [0.1, 0.4, 0.5]]]), votes.shape[1], axis=0)
    prior[:vetoes] = strength * np.array([[0.6, 0.3, 0.1], [0.01, 0.19, 0.8]])
    ahead = np.where((votes[:, :vetoes] < 0).any(axis=1), -1, votes.sum(axis=1))
    post = np.where(ahead > 0, 0.9, np.where(ahead < 0, 0.1, 0.5))
    cells = [(votes == v) for v in (-1, 0, 1)]
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        table = np.stack([np.einsum("cp,pl->lc", weight, cell) for cell in cells], axis=2) + prior
        table /= table.sum(axis=2, keepdims=True)
        table[:vetoes, 1, 0] = np.minimum(table[:vetoes, 1, 0], 0.01)
        table /= table.sum(axis=2, keepdims=True)
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        score = np.log([1 - share, share])[:, None] + sum(np.einsum("pl,lc->cp", cell, np.log(table[:, :, k])) for k, cell in enumerate(cells))
        now = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        if np.abs(now - post).max() < 1e-9:
            break
        post = now
    return table, float(share), post


def logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression with soft labels and an L2 penalty, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (counts * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (counts * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def features(kind: str, votes: str, more: str) -> set[str]:
    return {"1", kind} | {f"{kind}{i}{v}" for i, v in enumerate(votes)} | {f"t{i}{c}" for i, c in enumerate(more)}


def classify(patterns: list[tuple[str, str, str, int]]) -> dict[tuple[str, str, str], float]:
    """Probability of every (kind, votes, traits) pattern, given how often each occurs."""
    label: dict[tuple[str, str], float] = {}
    for kind in {p[0] for p in patterns}:
        by: dict[str, int] = {}
        for k, v, _, n in patterns:
            if k == kind:
                by[v] = by.get(v, 0) + n
        votes = np.array([["-0+".index(c) - 1 for c in v] for v in by])
        label |= {(kind, v): p for v, p in zip(by, reliabilities(votes, np.array(list(by.values()), float), VETOES)[2])}
    names = {f: i for i, f in enumerate(sorted(set().union(*(features(*p[:3]) for p in patterns))))} if patterns else {}
    x = np.zeros((len(patterns), len(names)))
    for row, p in zip(x, patterns):
        row[[names[f] for f in features(*p[:3])]] = 1
    if not patterns:
        return {}
    w = logistic(x, np.array([label[p[:2]] for p in patterns]), np.array([p[3] for p in patterns], float))
    return {p[:3]: float(1 / (1 + np.exp(-np.clip(v, -30, 30)))) for p, v in zip(patterns, x @ w)}


def pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, context: int = 40) -> DataFrame:
    """(doc_id, start, end, kind, probability) of spans that are personal data."""
    spark = docs.sparkSession
    workers_import(spark)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    found = written(own.mapInArrow(lambda batches: _find(batches, context), _FOUND), "candidates")
    # distinct patterns are bounded by their alphabet, whatever the corpus size
    patterns = sorted((r["kind"], r["votes"], r["traits"], r["count"]) for r in found.groupBy("kind", "votes", "traits").count().collect())
    table = spark.createDataFrame([(*k, p) for k, p in classify(patterns).items()], "kind string, votes string, traits string, probability double")
    judged = found.join(F.broadcast(table), ["kind", "votes", "traits"]).where(F.col("probability") >= least)
    return judged.select("doc_id", "start", "end", "kind", F.round("probability", 6).alias("probability"))
