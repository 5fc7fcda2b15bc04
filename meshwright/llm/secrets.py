"""Secrets found by how random they look.

Candidates are runs of base64, base64url, base62, base36, base32 or hexadecimal
symbols.  In the inferred alphabet each takes a battery of tests of the
hypothesis that it was drawn at random: chi-squared uniformity of symbols and of
symbol classes, the runs test about the middle of the alphabet, and serial
correlation at lag one; Fisher's method joins their p-values, by rank among
strings drawn at random.

Random strings have uniform p-values, other strings have small ones.  In every
stratum (encoding in either case and length band, as short strings reject less
surely) the share of random strings is estimated from the p-values above one half
of the distinct strings of the whole corpus, and the cut is the least p at which
the estimated share of other strings among those at or above it is at most
``fdr`` and these lie as evenly as random ones would.  A stratum of fewer than ``enough`` strings can't tell by itself: a string
has to pass the cut of its neighbours in length and the level ``fdr`` besides.

Defined results
---------------
* null and empty texts have no secrets, and stay as they are when redacted;
* repeated rows are scanned each; a null doc_id is reported as null;
* a run of small letters only, or of digits only, is no candidate: it is a word or
  a number;
* runs of fewer than ``shortest`` symbols aren't tested, as so few tell nothing;
* very long texts and runs are tested whole;
* a string that passes for random counts as a secret whatever it means; equal
  strings have equal p-values and count once in their stratum;
* an empty table has no secrets;
* spans are in characters; other columns are passed through or not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import drop_written, workers_import, written
from .textvec import chunks, id_column, string_buffers

DRAWN, REFERENCE_MOST = 2000, 512
BANDS = (16, 20, 24, 32, 40, 64, 128)
BINS = 200
_UPPER, _LOWER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
ALPHABETS = {
    "hex": _DIGIT + b"abcdef",
    "HEX": _DIGIT + b"ABCDEF",
    "base32": _UPPER + b"234567",
    "BASE36": _DIGIT + _UPPER,
    "base36": _DIGIT + _LOWER,
    "base62": _DIGIT + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGIT + b"+/",
    "base64url": _UPPER + _LOWER + _DIGIT + b"-_",
}
_SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}
_PLACE = {}
for _name, _symbols in ALPHABETS.items():
    _PLACE[_name] = np.full(256, -1, np.int64)
    _PLACE[_name][list(_symbols)] = np.arange(len(_symbols))
_CLASS = np.zeros(256, np.int64)
_CLASS[list(_UPPER)], _CLASS[list(_LOWER)], _CLASS[list(_DIGIT)] = 1, 2, 3
_RUN = _CLASS > 0
_RUN[list(b"+/_-")] = True


def _normal_tail(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in np.atleast_1d(z)])


def _gamma_tail(x: np.ndarray, mean: float, variance: float) -> np.ndarray:
    """Upper tail of the gamma law of these moments (Wilson and Hilferty)."""
    v = variance / (9 * mean * mean)
    return _normal_tail(((x / mean) ** (1 / 3) - (1 - v)) / math.sqrt(v))


def infer(token: bytes) -> str | None:
    """The smallest alphabet that explains a candidate."""
    kinds = set(token)
    has = [bool(kinds & set(x)) for x in (_UPPER, _LOWER, _DIGIT)]
    if not has[0] and sum(has) < 2:
        return None
    return next((name for name, symbols in _SETS.items() if kinds <= symbols), None)


def statistics(x: np.ndarray, encoding: str) -> np.ndarray:
    """p-values of strings of one length, given as rows of places in the alphabet:
    columns symbols, classes, runs and serial correlation, each by its usual law."""
    symbols = list(ALPHABETS[encoding])
    a, (many, n) = len(symbols), x.shape
    flat = np.repeat(np.arange(many), n)
    counts = np.bincount(flat * a + x.ravel(), minlength=many * a).reshape(many, a)
    p_symbols = _gamma_tail(((counts - n / a) ** 2).sum(axis=1) * a / n, a - 1, 2 * (a - 1) * (1 - 1 / n))
    kind = _CLASS[symbols]
    share = np.bincount(kind, minlength=4) / a
    use = share > 0
    seen = np.stack([counts[:, kind == c].sum(axis=1) for c in np.flatnonzero(use)], axis=1)
    k = int(use.sum())
    p_classes = _gamma_tail(((seen - n * share[use]) ** 2 / (n * share[use])).sum(axis=1), k - 1, 2 * (k - 1))
    high = x >= a // 2
    n1 = high.sum(axis=1)
    mean = 2 * n1 * (n - n1) / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    p_runs = 2 * _normal_tail(np.maximum(0, np.abs(runs - mean) - 0.5) / np.sqrt(np.maximum(variance, 1e-9)))
    p_runs[(n1 == 0) | (n1 == n)] = 2.0 ** (1 - n)
    y = x - (a - 1) / 2
    p_serial = 2 * _normal_tail(np.abs((y[:, 1:] * y[:, :-1]).sum(axis=1)) / ((a * a - 1) / 12 * math.sqrt(n - 1)))
    return np.clip(np.stack([p_symbols, p_classes, p_runs, p_serial], axis=1), 1e-300, 1.0)


@lru_cache(maxsize=4096)
def _reference(encoding: str, n: int) -> np.ndarray:
    """Fisher's statistic of strings of ``n`` symbols drawn at random, ascending."""
    rng = np.random.default_rng([n, len(encoding), *encoding.encode()])
    return np.sort(-np.log(statistics(rng.integers(0, len(ALPHABETS[encoding]), (DRAWN, n)), encoding)).sum(axis=1))


def batteries(x: np.ndarray, encoding: str) -> np.ndarray:
    """p-values of strings of one length: symbols, classes, runs, serial correlation, and all joined.

    The joint one is by rank among strings drawn at random of the same alphabet
    and length, which the usual laws fit badly where strings are short; beyond
    REFERENCE_MOST symbols they fit, and the statistic is held against their law.
    """
    ps = statistics(x, encoding)
    joined = -np.log(ps).sum(axis=1)  # half of Fisher's statistic, chi-squared with 8 degrees
    if x.shape[1] > REFERENCE_MOST:
        p = np.exp(-joined) * (1 + joined + joined**2 / 2 + joined**3 / 6)
    else:
        drawn = _reference(encoding, x.shape[1])
        p = 1 - (np.searchsorted(drawn, joined, "left") + np.searchsorted(drawn, joined, "right") + 1) / 2 / (DRAWN + 1)
    return np.column_stack([ps, np.minimum(1.0, p)])


def battery(token: bytes, encoding: str) -> tuple[float, ...]:
    """The p-values of one string."""
    return tuple(map(float, batteries(_PLACE[encoding][np.frombuffer(token, np.uint8)][None, :], encoding)[0]))


def candidates(raw: np.ndarray, offsets: np.ndarray, shortest: int = 16) -> Iterator[tuple[int, int, int]]:
    """(document, first byte, end) of runs that may be encoded."""
    edge = np.zeros(len(raw) + 2, np.int8)
    edge[1:-1] = _RUN[raw]
    d = np.diff(edge)
    starts, ends = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    cross = np.unique(inner[(edge[inner] == 1) & (edge[inner + 1] == 1)]) if len(inner) else inner
    if len(cross):
        starts, ends = np.sort(np.concatenate([starts, cross])), np.sort(np.concatenate([ends, cross]))
    long = ends - starts >= shortest
    starts, ends = starts[long], ends[long]
    upper, lower, digit = (sums[ends] > sums[starts] for sums in (np.concatenate([[0], np.cumsum(_CLASS[raw] == c)]) for c in (1, 2, 3)))
    maybe = upper | (lower & digit)
    starts, ends = starts[maybe], ends[maybe]
    docs = np.searchsorted(offsets, starts, "right") - 1
    return zip(docs.tolist(), starts.tolist(), ends.tolist())


def band(length: int) -> int:
    return max((b for b in BANDS if b <= length), default=0)


def parts(token: bytes, shortest: int = 16) -> list[tuple[int, int, str]]:
    """(start, end, encoding) of what is to be tested in a run.

    A run that mixes + or / with - or _ is in no alphabet and is split at all four;
    where that leaves no part of ``shortest`` symbols, at either pair alone.
    """
    if not (set(token) & set(b"+/") and set(token) & set(b"-_")):
        encoding = infer(token)
        return [(0, len(token), encoding)] if encoding else []
    found: list[tuple[int, int, str]] = []
    for inside in (rb"[^-_+/]+", rb"[^+/]+", rb"[^-_]+"):
        for m in re.finditer(inside, token):
            a, b = m.span()
            if b - a >= shortest and all(b <= x or y <= a for x, y, _ in found) and (encoding := infer(m.group())):
                found.append((a, b, encoding))
    return sorted(found)


def _tested(raw: np.ndarray, offsets: np.ndarray, shortest: int) -> list[tuple[int, int, int, str, tuple[float, ...]]]:
    """(document, start, end, encoding, p-values), in order; strings of one encoding and length are tested together."""
    found = [(d, a + x, a + y, encoding) for d, a, b in candidates(raw, offsets, shortest) for x, y, encoding in parts(raw[a:b].tobytes(), shortest)]
    alike: dict[tuple[str, int], list[int]] = {}
    for n, (_, a, b, encoding) in enumerate(found):
        alike.setdefault((encoding, b - a), []).append(n)
    ps: list[tuple[float, ...]] = [()] * len(found)
    for (encoding, length), own in alike.items():
        step = max(1, (1 << 20) // length)
        for i in range(0, len(own), step):
            some = own[i : i + step]
            x = _PLACE[encoding][np.stack([raw[found[n][1] : found[n][2]] for n in some])]
            for n, row in zip(some, batteries(x, encoding).tolist()):
                ps[n] = tuple(row)
    return [(*f, p) for f, p in zip(found, ps)]


_SPANS = "doc_id long, start long, end long, encoding string, length long, band long, p_symbols double, p_classes double, p_runs double, p_serial double, p double, h long"


def _scan(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = string_buffers(id_column(batch, "t"))
        ids, rows = id_column(batch, "id"), []
        for i, j in chunks(offsets):
            part, offs = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            lead = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
            for d, a, b, encoding, ps in _tested(part, offs, shortest):
                rows.append((ids[i + d].as_py(), int(lead[a] - lead[offs[d]]), int(lead[b] - lead[offs[d]]), encoding, b - a, band(b - a), *ps, xxhash.xxh3_64_intdigest(part[a:b].tobytes()) - (1 << 63)))
        if rows:
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.float64()] * 5 + [pa.int64()]
            names = [x.split()[0] for x in _SPANS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def cuts(counts: dict[tuple[str, int], np.ndarray], fdr: float, least_p: float, enough: int = 20) -> dict[tuple[str, int], float]:
    """The least p to accept in each stratum, from its histogram of p-values."""

    def cut(bins: np.ndarray) -> float:
        high = bins[BINS // 2 :].sum()
        random = 2 * (high + 1.65 * np.sqrt(high + 1))  # strings drawn at random, at the upper end of what this count allows
        above = np.cumsum(bins[::-1])[::-1]
        edges = np.arange(BINS) / BINS
        false = np.maximum(0, above - random * (1 - edges)) / np.maximum(above, 1)
        # what is accepted has to lie evenly above the cut, as far as its number can tell
        middle = np.cumsum((bins * (edges + 0.5 / BINS))[::-1])[::-1] / np.maximum(above, 1)
        even = (middle - edges) / (1 - edges) >= 0.5 - fdr - 1.65 / np.sqrt(12 * np.maximum(above, 1))
        good = np.flatnonzero((false <= fdr) & even & (above > 0))
        return max(least_p, float(edges[good[0]])) if len(good) else 2.0

    out = {}
    for family, length in counts:
        own = out[family, length] = cut(counts[family, length])
        if counts[family, length].sum() < enough:
            # too few to tell: its neighbours in length have a say as well, and so has the level itself
            bins = np.zeros(BINS)
            for _, b in sorted((abs(math.log((b + 1) / (length + 1))), b) for f, b in counts if f == family):
                if bins.sum() < enough:
                    bins = bins + counts[family, b]
            out[family, length] = max(own, cut(bins), fdr)
    return out


def _cuts_of(tested: DataFrame, fdr: float, least_p: float, enough: int) -> dict[tuple[str, int], float]:
    slot = F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int")
    counts: dict[tuple[str, int], np.ndarray] = {}
    strings = tested.select(F.lower("encoding").alias("family"), "band", slot.alias("slot"), "h").distinct()
    for r in strings.groupBy("family", "band", "slot").count().collect():  # at most strata x BINS rows
        counts.setdefault((r["family"], r["band"]), np.zeros(BINS))[r["slot"]] = r["count"]
    return cuts(counts, fdr, least_p, enough)


def _tests(docs: DataFrame, id_col: str, text_col: str, shortest: int) -> DataFrame:
    workers_import(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    return written(own.mapInArrow(lambda batches: _scan(batches, shortest), _SPANS), "tested")


def secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.05, least_p: float = 1e-3, enough: int = 20, shortest: int = 16) -> DataFrame:
    """A row for each secret: its span, encoding, p-values and stratum's cut."""
    tested = _tests(docs, id_col, text_col, shortest)
    cut = _cuts_of(tested, fdr, least_p, enough)
    spark = docs.sparkSession
    table = spark.createDataFrame([(k, b, c) for (k, b), c in cut.items()], "family string, band long, cut double")  # a row for each alphabet and band
    return tested.withColumn("family", F.lower("encoding")).join(F.broadcast(table), ["family", "band"]).where("p >= cut").select("doc_id", "start", "end", "encoding", "length", "p_symbols", "p_classes", "p_runs", "p_serial", "p", "cut")


def without_secrets(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", fdr: float = 0.05, least_p: float = 1e-3, enough: int = 20, shortest: int = 16
) -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mark``; no shuffle."""
    tested = _tests(docs, id_col, text_col, shortest)
    cut = _cuts_of(tested, fdr, least_p, enough)
    drop_written(tested)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            raw, offsets = string_buffers(batch.column(at))
            changed: dict[int, list[tuple[int, int]]] = {}
            for i, j in chunks(offsets):
                part, offs = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                for d, a, b, encoding, ps in _tested(part, offs, shortest):
                    if ps[-1] >= cut.get((encoding.lower(), band(b - a)), 2.0):
                        changed.setdefault(i + d, []).append((a + int(offsets[i]), b + int(offsets[i])))
            if changed:
                texts = batch.column(at).to_pylist()
                for d, spans in changed.items():
                    pieces, last = [], int(offsets[d])
                    for a, b in spans:
                        pieces += [raw[last:a].tobytes(), mark.encode()]
                        last = b
                    texts[d] = b"".join([*pieces, raw[last : offsets[d + 1]].tobytes()]).decode()
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
