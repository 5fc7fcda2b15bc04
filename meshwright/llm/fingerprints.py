"""Document fingerprints by consistent weighted sampling.

A document is a bag of words weighted by their counts.  For every coordinate and
word, r and c follow Gamma(2, 1) and b is uniform, all fixed by the word; with
t = floor(ln w / r + b), the sample is the word of least
ln a = ln c - r (t - b + 1), together with its t.  Two documents have the same
sample with a probability equal to their generalised Jaccard similarity, the sum
of least over the sum of greatest weights.

The three variates of all coordinates are slices of three fixed tables, at places
given by separate bits of the word's hash.

Defined results
---------------
* a null text, or one without words, has a null signature;
* repeated rows and null doc_ids each give a row; ties of ln a go to the lesser
  sample value; an empty table gives no rows;
* a document of one word repeated has a signature like any other, as counts
  enter through t; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import workers_import
from .textvec import U64, chunks, id_column, string_buffers, words

TABLE = 1 << 16


@lru_cache(maxsize=2)
def variates(width: int, seed: int) -> tuple[np.ndarray, ...]:
    """Windows of ``width`` values over tables of r, 1/r, ln c and b."""
    rng = np.random.default_rng(seed)
    r = rng.gamma(2, 1, TABLE)
    tables = (r, 1 / r, np.log(rng.gamma(2, 1, TABLE)), rng.random(TABLE))
    return tuple(np.lib.stride_tricks.sliding_window_view(np.concatenate([t, t[:width]]).astype(np.float32), width) for t in tables)


def bags(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, counts, where each document's begin)."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.concatenate([at, [len(h)]])), np.searchsorted(doc[at], np.arange(len(first)))


def samples(h: np.ndarray, weights: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A row for each term: ln a in the high and the sample in the low half of each value."""
    r, inverse, ln_c, b = variates(width, seed)
    low = U64(TABLE - 1)
    at_r, at_c, at_b = ((h >> U64(s) & low).astype(np.int64) for s in (0, 16, 32))
    shift = b[at_b]
    t = np.floor(np.log(weights.astype(np.float32))[:, None] * inverse[at_r] + shift)
    ln_a = ln_c[at_c] - r[at_r] * (t - shift + 1)
    bits = ln_a.view(np.uint32)
    ordered = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
    with np.errstate(over="ignore"):
        what = (h >> U64(20)).astype(np.uint32)[:, None] ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
        what *= np.uint32(0x85EBCA6B)
        what ^= what >> np.uint32(13)
    return (ordered.astype(U64) << U64(32)) | what


def signatures(h: np.ndarray, first: np.ndarray, width: int, seed: int, block: int = 1 << 13) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, documents that have one)."""
    terms, counts, begin = bags(h, first)
    n = len(first) - 1
    out = np.full((n, width), np.iinfo(U64).max, U64)
    for i, j in chunks(begin, block):
        lo, hi = int(begin[i]), int(begin[j])
        if hi - lo > block:
            for a in range(lo, hi, block):
                z = min(a + block, hi)
                np.minimum(out[i], samples(terms[a:z], counts[a:z], width, seed).min(axis=0), out=out[i])
        elif hi > lo:
            full = i + np.flatnonzero(np.diff(begin[i : j + 1]))
            out[full] = np.minimum.reduceat(samples(terms[lo:hi], counts[lo:hi], width, seed), begin[full] - lo, axis=0)
    return (out & U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), np.flatnonzero(np.diff(begin))


def _run(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffers(id_column(batch, "t"))
            for i, j in chunks(offsets):
                h, first = words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sig, some = signatures(h, first, width, seed)
                has = np.zeros(j - i, bool)
                has[some] = True
                ends = np.concatenate([[0], np.cumsum(np.where(has, width, 0))]).astype(np.int32)
                offs = pa.array(ends, mask=np.concatenate([~has, [False]]))
                lists = pa.ListArray.from_arrays(offs, pa.array(sig[some].ravel()))
                yield pa.RecordBatch.from_arrays([id_column(batch, "id").slice(i, j - i), pa.array(np.diff(first)), lists], names=["doc_id", "n_words", "signature"])

    return run


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 64, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, signature): ``width`` samples of each document, without a shuffle."""
    workers_import(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return own.mapInArrow(_run(width, seed), "doc_id long, n_words long, signature array<int>")
