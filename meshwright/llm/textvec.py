"""Vectorised word splitting and hashing straight from Arrow string buffers.

A word is a maximal run of ASCII letters and digits and of bytes of non-ASCII
characters; ASCII letters and the two-byte Latin-1 capitals are folded to lower
case. Every function here works on whole texts; batches are cut between
documents so that the temporary arrays stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_powers: list[np.ndarray] = []

#: Bytes of text handled at once; a longer document is handled alone.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(U64, copy=True) if x.dtype != U64 else x.copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        out = []
        for b in (_BASE, inverse):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.cumprod(p, dtype=U64))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes, or of one document."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def folded(raw: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the two-byte Latin-1 capitals."""
    low = _LOWER[raw]
    lead = np.flatnonzero(low[:-1] == 0xC3) + 1
    if len(lead):
        b = low[lead]
        up = (b >= 0x80) & (b <= 0x9E) & (b != 0x97)
        low[lead[up]] = b[up] + 32
    return low


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of words: ``first[d]:first[d+1]`` are those of document d."""
    is_word = np.zeros(len(raw) + 2, dtype=np.int8)
    is_word[1:-1] = _WORD[raw]
    d = np.diff(is_word)
    starts, ends = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    # a word never crosses into the next document
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    cross = np.unique(inner[(is_word[inner] == 1) & (is_word[inner + 1] == 1)]) if len(inner) else inner
    if len(cross):
        starts = np.sort(np.concatenate([starts, cross]))
        ends = np.sort(np.concatenate([ends, cross]))
    return starts, ends, np.searchsorted(starts, offsets, "left")


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, independent of where it lies."""
    if not len(starts):
        return np.zeros(0, U64)
    pw, inv = powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((low.astype(U64) + U64(1)) * pw[:-1], out=sums[1:])
        h = (sums[ends] - sums[starts]) * inv[starts]
        return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each document and the total)."""
    starts, ends, first = word_spans(raw, offsets)
    return span_hashes(folded(raw), starts, ends), first


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``k`` words, and where each document's begin.

    A document of 1 to k-1 words has one shingle of all of its words.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    if not begin[-1]:
        return np.zeros(0, U64), begin
    at = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    size = np.repeat(np.minimum(n, k), count)
    out = np.zeros(begin[-1], U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            use = size > j
            part = h[np.minimum(at + j, len(h) - 1)] + U64(1)
            out = np.where(use, (out ^ (out >> U64(29))) * U64(0x9FB21C651E98DF25) + part, out)
    return mix(out), begin


def id_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
