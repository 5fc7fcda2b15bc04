"""Packing documents into sequences of fixed length by bin completion.

Documents longer than the capacity first give full sequences of their own; what
remains of them and all shorter ones are items.  A branch and bound completes one
bin at a time: the largest unpacked item opens it, and the fillings tried around
it are the undominated ones, least waste first and then the largest items.  The
incumbent is best-fit decreasing; a branch ends when its waste leaves no room for
a better solution, the search when the incumbent meets the lower bound, when
nothing is left or after ``nodes`` sets.

Items are packed in blocks of about ``block`` documents, chosen by a hash of the
doc_id, so that blocks are packed independently whatever the corpus size.

Defined results
---------------
* null, empty and blank texts have no tokens and are in no pack;
* repeated rows are items each; rows whose doc_id is null are packed under null;
* equal lengths are told apart by doc_id only to make results repeatable;
* a very long text gives full sequences and one item, whatever its length;
* an empty table gives no packs; only the named columns are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import workers_import, written
from .mixing import token_count
from .textvec import id_column

_PACKS = "pack_id long, n_tokens long, pieces array<struct<doc_id: long, start: long, n_tokens: long>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each size goes to the fullest bin that it fits."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    for s in sorted(sizes, reverse=True):
        at = bisect_left(room, (s, -1))
        if at == len(room):
            free, b = capacity, len(bins)
            bins.append([])
        else:
            free, b = room.pop(at)
        bins[b].append(s)
        if free > s:
            insort(room, (free - s, b))
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """The greater of the total's bound and Martello and Toth's L2."""
    if not sizes:
        return 0
    asc = sorted(sizes)
    prefix = [0]
    for s in asc:
        prefix.append(prefix[-1] + s)
    best = -(-prefix[-1] // capacity)
    for a in [0, *sorted({s for s in asc if 2 * s <= capacity})]:
        lo, mid, hi = bisect_left(asc, a), bisect_left(asc, capacity // 2 + 1), bisect_left(asc, capacity - a + 1)
        n2 = hi - mid
        rest = prefix[mid] - prefix[lo] - (n2 * capacity - (prefix[hi] - prefix[mid]))
        best = max(best, len(asc) - mid + max(0, -(-rest // capacity)))
    return best


def reaches(asc: list[int], counts: dict[int, int], room: int) -> list[int]:
    """For every size up to ``room``, as bits, the sums that it and the lesser ones reach."""
    mask, bits, out = (2 << room) - 1, 1, []
    for s in asc:
        if s > room:
            break
        left, several = counts[s], 1
        while left > 0 and s * several <= room:
            several = min(several, left)
            bits |= bits << s * several & mask
            left -= several
            several *= 2
        out.append(bits)
    return out


def fillings(room: int, asc: list[int], counts: dict[int, int], left: list[int], slack: int | None = None) -> Iterator[list[int]]:
    """Undominated sets of available sizes that fit ``room`` and waste at most ``slack``
    (any waste if None): least waste first, then the largest sizes.

    ``asc`` has the distinct available sizes.  A set is dominated if another
    available size could take the place of some of its members, or of none, that
    sum up to as much or to less by no more than the waste.  Each set looked at
    costs one of ``left``.  Sets are built along sums known to be reachable, so
    no step is wasted, and by sizes with their numbers, so that many equal sizes
    cost no more than one.
    """
    reach = reaches(asc, counts, room)
    own = asc[: len(reach)]
    have = [counts[s] for s in own]
    every = sum(1 << s for s in own)

    def step(i: int, m: int, rest: int) -> tuple[int, int] | None:
        """The next size at or below place i, with its number (m at most at i), from which lesser ones reach the rest."""
        while i >= 0 and reach[i] >> rest & 1:
            below, s = reach[i - 1] if i else 1, own[i]
            for m in range(min(m, rest // s), 0, -1):
                if below >> rest - m * s & 1:
                    return i, m
            i -= 1
            m = have[i]
        return None

    def exact(total: int) -> Iterator[list[tuple[int, int]]]:
        """Sets of exactly this sum as places with numbers, largest first."""
        path: list[tuple[int, int, int]] = []
        i, rest = len(own) - 1, total
        m = have[i] if own else 0
        while True:
            if rest and (found := step(i, m, rest)):
                i, m = found
                path.append((i, m, rest))
                rest -= m * own[i]
                i -= 1
                m = have[i]
                continue
            if not rest:
                yield [(i, m) for i, m, _ in path]
            if not path:
                return
            i, m, rest = path.pop()
            m -= 1

    def dominated(chosen: list[tuple[int, int]], waste: int) -> bool:
        unused = every
        for i, m in chosen:
            if m == have[i]:
                unused ^= 1 << own[i]
        sums, low = 1, 0  # of members up to ``low``
        for s, m in [*((own[i], m) for i, m in reversed(chosen)), (room, 0)]:
            wide, done = sums, 0
            while done < waste:
                more = min(done + 1, waste - done)
                wide |= wide << more
                done += more
            if (wide & unused & (2 << s) - 1) >> low + 1:
                return True
            several = 1
            while m > 0:
                several = min(several, m)
                sums |= sums << s * several
                m -= several
                several *= 2
            low = s
        return False

    top = reach[-1] if reach else 1
    for total in range(top.bit_length() - 1, -1 if slack is None else max(-1, room - slack - 1), -1):
        if top >> total & 1:
            for chosen in exact(total):
                if left[0] <= 0:
                    return
                left[0] -= 1
                if not dominated(chosen, room - total):
                    yield [own[i] for i, m in chosen for _ in range(m)]


def _search(sizes: list[int], capacity: int, best: list[list[int]], bound: int, width: int, left: list[int]) -> tuple[list[list[int]], bool]:
    """(the best of ``best`` and what is found, whether nothing was left out), trying ``width`` fillings a bin."""
    counts: dict[int, int] = {}
    for s in sizes:
        counts[s] = counts.get(s, 0) + 1
    asc, total, n_left, wasted, whole = sorted(counts), sum(sizes), len(sizes), 0, True
    path: list[tuple[int, list[int] | None, Iterator[list[int]], int]] = []  # largest size, filling, the others, how many were tried

    def take(s: int) -> None:
        nonlocal n_left
        counts[s] -= 1
        n_left -= 1
        if not counts[s]:
            asc.pop(bisect_left(asc, s))

    def give(s: int) -> None:
        nonlocal n_left
        if not counts[s]:
            insort(asc, s)
        counts[s] += 1
        n_left += 1

    def open_bin() -> None:
        s = asc[-1]
        take(s)
        path.append((s, None, fillings(capacity - s, asc, counts, left, (len(best) - 1) * capacity - total - wasted), 0))

    open_bin()
    while path and left[0] > 0:
        s, chosen, more, tried = path[-1]
        if chosen is not None:
            for x in chosen:
                give(x)
            wasted -= capacity - s - sum(chosen)
        following = next(more, None)
        if following is None or tried == width:
            whole = whole and following is None
            path.pop()
            give(s)
            continue
        for x in following:
            take(x)
        wasted += capacity - s - sum(following)
        path[-1] = (s, following, more, tried + 1)
        if wasted > (len(best) - 1) * capacity - total:
            continue
        if not n_left:
            best = [[a, *(b or [])] for a, b, _, _ in path]
            if len(best) <= bound:
                break
        elif len(path) < len(best) - 1:
            open_bin()
    return best, whole and left[0] > 0


def pack(sizes: list[int], capacity: int, nodes: int = 20000) -> list[list[int]]:
    """Bins of sizes: optimal if the search ends within ``nodes`` sets, else the best found.

    The search tries one filling a bin, then two, four and so on, until it has
    left nothing out: its first dives repair best fit at small cost, however many
    bins there are.
    """
    best, left, width, whole = best_fit(sizes, capacity), [nodes], 1, False
    bound = lower_bound(sizes, capacity)
    while len(best) > bound and left[0] > 0 and not whole:
        best, whole = _search(sizes, capacity, best, bound, width, left)
        width *= 2
    return best


def _pack_blocks(capacity: int, nodes: int):
    """Packs of the blocks of a partition; rows arrive sorted by block."""

    def packed(block: int, docs: list[tuple[int | None, int]]) -> list[tuple]:
        docs.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        full = [[(d, a, capacity)] for d, n in docs for a in range(0, n - capacity + 1, capacity)]
        by: dict[int, list[tuple]] = {}
        for d, n in reversed(docs):
            if n % capacity:
                by.setdefault(n % capacity, []).append((d, n - n % capacity, n % capacity))
        bins = pack([s for s in by for _ in by[s]], capacity, nodes)
        rows = full + [[by[s].pop() for s in sizes] for sizes in bins]
        return [((block << 32) + i, sum(p[2] for p in row), [{"doc_id": d, "start": a, "n_tokens": n} for d, a, n in row]) for i, row in enumerate(rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
        block, items = None, []

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], piece)], names=["pack_id", "n_tokens", "pieces"])

        for batch in batches:
            for b, doc, n in zip(*(id_column(batch, c).to_pylist() for c in ("block", "id", "n"))):
                if b != block:
                    if items:
                        yield out(packed(block, items))
                    block, items = b, []
                items.append((doc, n))
        if items:
            yield out(packed(block, items))

    return run


def packs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, block: int = 4096, nodes: int = 20000) -> DataFrame:
    """(pack_id, n_tokens, pieces): sequences of at most ``capacity`` tokens.

    A piece is a run of a document's tokens (words between white space): its
    doc_id, first token and number of tokens.  Every token is in one piece.
    """
    workers_import(docs.sparkSession)
    lengths = docs.select(F.col(id_col).cast("long").alias("id"), token_count(F.col(text_col).cast("string")).alias("n")).where("n > 0")
    lengths = written(lengths, "lengths")
    blocks = max(1, -(-lengths.count() // block))
    part = lengths.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    return part.repartition("block").sortWithinPartitions("block").mapInArrow(_pack_blocks(capacity, nodes), _PACKS)
