"""Passages of many words that occur more than once, found with FM-indexes.

Any passage of ``least`` words contains a winnowing anchor: the run of ``k`` words
of least hash.  Equal passages have equal anchors at the same place, so all
occurrences of an anchor that comes more than once go, with the words around
them that a passage could cover, to the shard of that anchor's hash.  There,
their distinct surroundings are indexed by the Burrows-Wheeler transform in a
wavelet matrix with rank counts, and each is streamed through by backward search,
right to left.  An interval of the suffix order that shrinks below two falls
back to its parent (by common-prefix lengths), so that every word gets its
matching statistic: how many words from there on occur elsewhere as well.
Matches of at least ``least`` words cover their words; a document's covered words
are reported as maximal intervals.

Symbols of the index are words at their distance from their anchor, so a match
is between two different places, never between two surroundings of one.

The runs of ``least`` words around an anchor begin at neighbouring places; a few
ranges of these are looked at one after another.  All runs of a range have a core
of words in common, so surroundings meet in the index only if their cores are
equal, and whatever recurs in a range as a whole is covered without a search.
An anchor of more than ``hot`` occurrences, as in a licence, would make one shard
of them all; its runs are counted one by one instead, spread by their hashes.

Defined results
---------------
* words are those of :mod:`textvec`; intervals count words, the end exclusive;
* a repetition within one document counts like one between two;
* null and empty texts and those below ``least`` words have no intervals; very
  long ones are searched whole;
* repeated rows of a doc_id count once; rows whose doc_id is null aren't reported;
* an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import drop_written, workers_import, written
from .textvec import U64, chunks, id_column, mix, powers, string_buffers, words

#: Words in an index.
BLOCK = 1 << 20
#: Ranges of the places where runs around an anchor begin.
RANGES = 4


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` words."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ (out >> U64(29))) * U64(0x9FB21C651E98DF25) + h[j : j + n]
    return mix(out)


def anchors(g: np.ndarray, first: np.ndarray, k: int, least: int) -> np.ndarray:
    """Where the least gram of a passage of ``least`` words stands, over all passages."""
    width = least - k + 1
    if len(g) < width:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begins = np.arange(len(g) - width + 1)
    begins = begins[doc[begins] == doc[begins + least - 1]]
    if not len(begins):
        return begins
    # the least of every window, by doubling; the leftmost of equal ones
    at, size = np.arange(len(g)), 1
    while 2 * size <= width:
        left, right = at[: len(at) - size], at[size:]
        at = np.where(g[right] < g[left], right, left)
        size *= 2
    left, right = at[begins], at[begins + width - size]
    return np.unique(np.where(g[right] < g[left], right, left))


_BELOW = (U64(1) << np.arange(64, dtype=U64)) - U64(1)


class WaveletMatrix:
    """Symbols in ``levels`` bit vectors with rank counts."""

    def __init__(self, x: np.ndarray, symbols: int):
        self.n, self.levels = len(x), max(1, int(symbols - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = (x >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            bits = np.zeros(len(x) // 64 + 1, U64)
            bits.view(np.uint8)[: len(packed)] = packed
            self.bits.append(bits)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)[:-1]]))
            self.zeros.append(int(len(x) - bit.sum()))
            x = np.concatenate([x[~bit], x[bit]])
        self.begin = np.zeros(symbols, np.int64)
        new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
        self.begin[x[new]] = new

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many symbols ``c`` stand before place ``i``."""
        for level, bits, counts, zeros in zip(reversed(range(self.levels)), self.bits, self.counts, self.zeros):
            w = i >> 6
            ones = counts[w] + np.bitwise_count(bits[w] & _BELOW[i & 63])
            i = np.where(c & (1 << level), zeros + ones, i - ones)
        return i - self.begin[c]


class Index:
    """An FM-index of texts that are separated by the symbol 0."""

    def __init__(self, x: np.ndarray, symbols: int, depth: int):
        """``depth``: a length that patterns stay below."""
        n = self.n = len(x)
        ranks = [(1, x)]
        size, rank = 1, x
        while size < depth:
            behind = np.zeros(n, np.int64)
            behind[: n - size] = rank[size:] + 1
            key = rank.astype(np.int64) * (n + symbols + 1) + behind
            order = np.argsort(key)
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)])) if n else 0
            size *= 2
            ranks.append((size, rank.astype(np.int32)))
            if n and int(rank.max()) == n - 1:
                break
        order = np.argsort(rank)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=symbols))])
        self.wavelets = WaveletMatrix(x[order - 1], symbols)
        # common prefixes of neighbours in the order, from the ranks by doubled lengths
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(0, n - 1), np.int64)
        for size, r in reversed(ranks):
            inside = np.maximum(a, b) + size <= n
            same = inside & (r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)])
            common += np.where(same, size, 0)
            a += np.where(same, size, 0)
            b += np.where(same, size, 0)
        # longer than any pattern is as good as any length
        kind = np.uint8 if depth < 1 << 8 else np.uint16 if depth < 1 << 16 else np.uint32
        lcp = np.zeros(n + 1, kind)
        lcp[1:n] = np.minimum(common, np.iinfo(kind).max)
        self.least = [lcp]
        while 2 ** len(self.least) <= n:
            last, half = self.least[-1], 2 ** (len(self.least) - 1)
            self.least.append(np.minimum(last[:-half], last[half:]))

    def extend(self, c: np.ndarray, sp: np.ndarray, ep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of a longer pattern: backward search."""
        both = np.tile(self.before[c], 2) + self.wavelets.rank(np.tile(c, 2), np.concatenate([sp, ep]))
        return both[: len(c)], both[len(c) :]

    def parent(self, sp: np.ndarray, ep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The interval of the longest proper prefix that more suffixes share, and its length.

        Both ends go outwards while common prefixes are long enough, by doubled
        steps first and then by halved ones.
        """
        size = np.maximum(self.least[0][sp], self.least[0][ep])
        some = np.flatnonzero(size)
        a, b, need = sp[some], ep[some], size[some]
        for step in (-1, 1):
            at, j = a if step < 0 else b, 0
            while j < len(self.least) and len(at) and self._wide(at, step, j, need).any():
                j += 1
            for k in reversed(range(j)):
                at = at + np.where(self._wide(at, step, k, need), step << k, 0)
            a, b = (at, b) if step < 0 else (a, at)
        left, right = np.zeros(len(sp), np.int64), np.full(len(sp), self.n)
        left[some], right[some] = a, b
        return left, right, size.astype(np.int64)

    def _wide(self, at: np.ndarray, step: int, j: int, need: np.ndarray) -> np.ndarray:
        """Whether 2**j more suffixes that way share a prefix of the needed length."""
        least = self.least[j]
        first = at - (1 << j) + 1 if step < 0 else at
        inside = first >= 0 if step < 0 else first < len(least)
        return inside & (least[np.where(inside, first, 0)] >= need)

    def matching(self, rows: np.ndarray, need: int, least: int = 0) -> np.ndarray:
        """Matching statistics of texts: how far from each word ``need`` occurrences go.

        ``rows`` has a text a row, filled up with 0 on the right; a negative
        symbol isn't in the index.  A text's statistics stay 0 to the left of
        where its matches end before word ``least``: ends only move left, so none
        of that length can follow.
        """
        count, width = rows.shape
        out = np.zeros((count, width), np.int64)
        sp, ep, size = np.zeros(count, np.int64), np.full(count, self.n), np.zeros(count, np.int64)
        live = np.arange(count)
        for j in reversed(range(width)):
            here = rows[live, j]
            unknown = live[here < 0]
            sp[unknown], ep[unknown], size[unknown] = 0, self.n, 0
            left = live[here > 0]
            while len(left):
                a, b = self.extend(rows[left, j], sp[left], ep[left])
                ok = b - a >= need
                done = left[ok]
                sp[done], ep[done] = a[ok], b[ok]
                size[done] += 1
                left = left[~ok]
                none = size[left] == 0
                sp[left[none]], ep[left[none]] = 0, self.n
                left = left[~none]
                if len(left):
                    sp[left], ep[left], size[left] = self.parent(sp[left], ep[left])
            out[live, j] = size[live]
            if j < least:
                live = live[j + size[live] >= least]
        return out


def covered(texts: list[np.ndarray], group: np.ndarray, anchor: np.ndarray, least: int, block: int = BLOCK, ask: np.ndarray | None = None) -> np.ndarray:
    """(start, end) of what each text, or each of those marked in ``ask``, shares
    with another of its group; 0, 0 for nothing.

    Texts are distinct within their group, and come sorted by group.  More words
    than a block are indexed in parts, and every text is streamed through all.
    """
    found = np.zeros((len(texts), 2), np.int64)
    if not len(texts):
        return found
    sizes = np.array([len(t) for t in texts])
    width = int(sizes.max())
    flat = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        place = mix(group.astype(np.int64).view(U64))[flat] + (inside - anchor[flat]).astype(np.int64).view(U64) * U64(0xD6E8FEB86659FD93)
        coded = mix(mix(place) + np.concatenate(texts).astype(U64))
    part = np.cumsum(sizes) // block
    for p in np.unique(part):
        own = part[flat] == p
        names, symbols = np.unique(coded[own], return_inverse=True)
        text = np.zeros(int(own.sum()) + int((part == p).sum()), np.int64)
        gap = np.cumsum(np.concatenate([[0], (np.diff(flat[own]) > 0).astype(np.int64)]))
        text[np.arange(len(symbols)) + gap] = symbols + 1
        index = Index(text, len(names) + 1, width + 1)
        near = np.isin(group, group[part == p])
        for q in np.unique(part[near]):
            wanted = near & (part == q)
            if ask is not None:
                wanted &= ask
            these = np.flatnonzero(wanted)
            rows = np.zeros((len(these), width), np.int64)
            use = wanted[flat]
            known = np.minimum(np.searchsorted(names, coded[use]), len(names) - 1)
            rows[np.searchsorted(these, flat[use]), inside[use]] = np.where(names[known] == coded[use], known + 1, -1)
            ms = index.matching(rows, 2 if p == q else 1, least)
            good = ms >= least
            some = good.any(axis=1)
            start, end = good.argmax(axis=1), np.where(good, ms + np.arange(width), 0).max(axis=1)
            had = found[these, 1] > 0
            found[these[some & had], 0] = np.minimum(found[these, 0], start)[some & had]
            found[these[some & ~had], 0] = start[some & ~had]
            found[these[some], 1] = np.maximum(found[these, 1], end)[some]
    return found


def _batch(names: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _anchored(k: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = id_column(batch, "id").to_numpy(zero_copy_only=False)
            raw, offsets = string_buffers(id_column(batch, "t"))
            for i, j in chunks(offsets):
                h, first = words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                g = grams(h, k)
                at = anchors(g, first, k, least)
                doc = np.searchsorted(first, at, "right") - 1
                yield _batch("fp id pos", [g[at].view(np.int64), ids[i + doc], (at - first[doc]).astype(np.int32)])

    return run


def _placed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, word hashes, first words, gram at, document of, place of) each place, for a chunk of documents at a time."""
    for batch in batches:
        ids = id_column(batch, "id").to_numpy(zero_copy_only=False)
        raw, offsets = string_buffers(id_column(batch, "t"))
        lists = id_column(batch, "places")
        many = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends, flat = np.concatenate([[0], np.cumsum(many)]), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in chunks(offsets):
            h, first = words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            g = grams(h, k)
            doc = np.repeat(np.arange(j - i), many[i:j])
            at = first[doc] + flat[ends[i] : ends[j]]
            fits = at + k <= first[doc + 1]
            doc, at = doc[fits], at[fits]
            if len(at):
                yield ids[i + doc], h, first, g[at], doc, at


def _surroundings(k: int, least: int):
    before, behind = least - k, least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, h, first, fp, doc, at in _placed(batches, k):
            start, end = np.maximum(at - before, first[doc]), np.minimum(at + behind, first[doc + 1])
            bytes_ = (h >> U64(32)).astype(np.uint32).tobytes()
            name = np.zeros(len(at), U64)  # a hash of the surroundings, by the anchor
            with np.errstate(over="ignore"):
                for step in range(before + behind):
                    use = start + step < end
                    name = np.where(use, (name ^ (name >> U64(29))) * U64(0x9FB21C651E98DF25) + h[np.minimum(start + step, len(h) - 1)] + U64(1), name)
                name = mix(name + mix(fp) + (at - start).astype(U64) * U64(0xD1B54A32D192ED03))
            _, once = np.unique(name, return_index=True)
            text: list[bytes | None] = [None] * len(at)
            for r in once:
                text[r] = bytes_[4 * start[r] : 4 * end[r]]
            yield _batch("fp name id start anchor words", [fp.view(np.int64), name.view(np.int64), ids, (start - first[doc]).astype(np.int32), (at - start).astype(np.int32), pa.array(text, pa.binary())])

    return run


def _runs(k: int, least: int):
    """A row for each run of ``least`` words around a place: the hash of its words, place and anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, h, first, fp, doc, at in _placed(batches, k):
            sums = _sums(h)
            for p in range(k - least, 1):
                begin = at + p
                use = (begin >= first[doc]) & (begin + least <= first[doc + 1])
                with np.errstate(over="ignore"):
                    own = mix(_between(sums, begin[use], begin[use] + least) + mix(fp[use]) + U64(p - k + least))
                yield _batch("run id s", [own.view(np.int64), ids[use], (begin - first[doc])[use].astype(np.int64)])

    return run


def _sums(h: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(h) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(h) * powers(len(h) + 1)[0][:-1], out=sums[1:])
    return sums


def _between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, independent of where they lie."""
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def shared(texts: list[np.ndarray], fp: np.ndarray, anchor: np.ndarray, times: np.ndarray, k: int, least: int, block: int = BLOCK) -> np.ndarray:
    """(start, end) of what each text has in common with another of its anchor, as
    runs of ``least`` words that cover the anchor; a text that occurs several
    ``times`` has all of them.  0, 0 for nothing."""
    out = np.zeros((len(texts), 2), np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(size) - size + anchor  # where the anchors stand in the texts end to end
    sums = _sums(np.concatenate(texts).astype(U64)) if len(texts) else np.zeros(1, U64)
    step = max(1, (least - k + 1) // RANGES)
    segments: list[np.ndarray] = []
    parts: list[tuple[np.ndarray, ...]] = []
    for p in range(k - least, 1, step):
        q = min(p + step - 1, 0)
        lo, hi = np.maximum(p, -anchor), np.minimum(q, size - anchor - least)
        own = np.flatnonzero(lo <= hi)
        if not len(own):
            continue
        lo, hi, at = lo[own], hi[own], base[own]
        with np.errstate(over="ignore"):
            core = mix(_between(sums, at + q, at + p + least) + mix(fp[own].view(U64)) + U64(p - k + least))
            name = mix(_between(sums, at + lo, at + hi + least) + mix(core) + (lo - p).astype(U64) * U64(0xD1B54A32D192ED03))
        _, first, which = np.unique(name, return_index=True, return_inverse=True)
        full = np.bincount(which, times[own]) > 1
        _, group, many = np.unique(core[first], return_inverse=True, return_counts=True)
        # a group is searched if some of it isn't covered as a whole and has company
        ask = ~full & (many[group] > 1)
        busy = np.zeros(len(many), bool)
        busy[group[ask]] = True
        some = np.full(len(first), -1)
        for n, u in enumerate(np.flatnonzero(busy[group]), len(segments)):
            r = first[u]
            t, a = own[r], anchor[own[r]]
            segments.append(texts[t][a + lo[r] : a + hi[r] + least])
            some[u] = n
        use = np.flatnonzero(busy[group])
        parts.append((own, which, lo, hi, full, some, core[first][use].view(np.int64), -lo[first][use], ask[use]))
    groups, anchors_, asks = (np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, np.int64) for n in (6, 7, 8))
    order = np.argsort(groups, kind="stable")
    found = np.zeros((len(segments), 2), np.int64)
    found[order] = covered([segments[n] for n in order], groups[order], anchors_[order], least, block, asks[order].astype(bool))
    for own, which, lo, hi, full, some, *_ in parts:
        n = some[which]
        got = np.where((n >= 0)[:, None], found[n] if len(found) else 0, 0)
        whole = full[which]
        start = anchor[own] + lo + np.where(whole, 0, got[:, 0])
        end = np.where(whole, anchor[own] + hi + least, np.where(got[:, 1] > 0, anchor[own] + lo + got[:, 1], 0))
        use = end > 0
        t, had = own[use], out[own[use], 1] > 0
        out[t, 0] = np.where(had, np.minimum(out[t, 0], start[use]), start[use])
        out[t, 1] = np.maximum(out[t, 1], end[use])
    return out


def _match(k: int, least: int, block: int):
    def solve(fp: np.ndarray, name: np.ndarray, ids: np.ndarray, start: np.ndarray, anchor: np.ndarray, text: list[bytes | None]) -> pa.RecordBatch:
        order = np.lexsort((name, fp))
        new = np.concatenate([[True], (name[order][1:] != name[order][:-1]) | (fp[order][1:] != fp[order][:-1])])
        which = np.empty(len(fp), np.int64)
        which[order] = np.cumsum(new) - 1
        lead = order[new]
        times = np.bincount(which)
        texts: list[np.ndarray | None] = [None] * len(lead)
        for r, t in enumerate(text):
            if t is not None and texts[which[r]] is None:
                texts[which[r]] = np.frombuffer(t, np.uint32)
        found = shared(texts, fp[lead], anchor[lead].astype(np.int64), times, k, least, block)
        use = found[which, 1] > 0
        return _batch("id s e", [ids[use], (start + found[which, 0])[use].astype(np.int64), (start + found[which, 1])[use].astype(np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(6)]
        size = 0
        for batch in batches:
            own = [id_column(batch, c).to_numpy(zero_copy_only=False) for c in ("fp", "name", "id", "start", "anchor")] + [id_column(batch, "words").to_pylist()]
            n = np.cumsum([0 if w is None else len(w) // 4 for w in own[5]])
            at = 0
            while at < len(n):
                # up to the end of the anchor with which the block is full
                full = int(np.searchsorted(n, (n[at - 1] if at else 0) + block - size))
                full = max(full, at + 1)
                ends = np.flatnonzero(own[0][full:] != own[0][full - 1 : -1])
                stop = full + int(ends[0]) if len(ends) else len(n)
                for h, c in zip(held, own):
                    h.append(c[at:stop])
                size += int(n[stop - 1] - (n[at - 1] if at else 0))
                if stop < len(n):
                    yield solve(*(np.concatenate(h) for h in held[:5]), [w for part in held[5] for w in part])
                    held, size = [[] for _ in range(6)], 0
                at = stop
        if held[0]:
            yield solve(*(np.concatenate(h) for h in held[:5]), [w for part in held[5] for w in part])

    return run


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 50, k: int = 8, block: int = BLOCK, hot: int = 1 << 14) -> DataFrame:
    """(doc_id, start_word, end_word): maximal intervals of words covered by
    passages of at least ``least`` words that occur elsewhere in the corpus too.

    ``block`` and ``hot`` say how the work is divided; the result doesn't depend on them.
    """
    spark = docs.sparkSession
    workers_import(spark)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null and t is not null")
    marks = written(own.mapInArrow(_anchored(k, least), "fp long, id long, pos int"), "anchors")
    again = marks.join(marks.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1"), "fp")
    pick = lambda found: F.array_sort(F.collect_set(F.when(found, F.col("pos"))))
    places = written(again.groupBy("id").agg(pick(F.col("n") <= hot).alias("places"), pick(F.col("n") > hot).alias("hot")), "places")
    # always shuffled joins: what repeats grows with the corpus
    texts = lambda chosen: own.join(places.where(F.size(chosen) > 0).select("id", F.col(chosen).alias("places")).hint("merge"), "id").dropDuplicates(["id", "t"])
    around = texts("places").mapInArrow(_surroundings(k, least), "fp long, name long, id long, start int, anchor int, words binary")
    hits = around.repartition("fp").sortWithinPartitions("fp").mapInArrow(_match(k, least, block), "id long, s long, e long")
    if not places.where(F.size("hot") > 0).isEmpty():
        runs = written(texts("hot").mapInArrow(_runs(k, least), "run long, id long, s long"), "runs")
        repeated = runs.groupBy("run").agg(F.count("*").alias("n")).where("n > 1")
        hits = hits.union(runs.join(repeated, "run").select("id", "s", (F.col("s") + least).alias("e")))
    drop_written(marks)
    by = Window.partitionBy("id").orderBy("s", "e")
    begins = hits.withColumn("far", F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    runs = begins.withColumn("run", F.sum(F.when(F.col("far") >= F.col("s"), 0).otherwise(1)).over(by))
    return runs.groupBy("id", "run").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word")).select(F.col("id").alias("doc_id"), "start_word", "end_word")
