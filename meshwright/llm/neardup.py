"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard.

Two random permutations of a universe of 2**20 give all signature coordinates:
the first scatters the hashed shingles, the second is used at every circular
shift, coordinate j of a document being the least ``pi[(sigma[s] + j) mod D]``
over its shingles s.  A shingle's values for all coordinates are therefore one
contiguous slice of ``pi``.

Defined results
---------------
* a null text is in no group but its own; so is a text without any word, but for
  byte-equal texts, which are one group;
* repeated rows of a doc_id count once, and one with several texts is near whatever
  any of them is near; rows whose doc_id is null aren't reported;
* a very long text is compared whole; beyond some 100,000 distinct shingles it fills
  the universe and becomes a candidate of others of its kind, which costs exact
  comparisons but changes no result;
* a group's id is the least doc_id in it, and that document is the kept one;
* an empty table gives an empty result; other columns, whatever their names, are
  never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import drop_written, workers_import, written
from .textvec import U64, chunks, id_column, mix, shingles, string_buffers, words

UNIVERSE = 1 << 20


@lru_cache(maxsize=2)
def permutations(width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    sigma = rng.permutation(UNIVERSE).astype(np.uint32)
    pi = rng.permutation(UNIVERSE).astype(np.uint32)
    wrapped = np.concatenate([pi, pi[:width]])
    return sigma, np.lib.stride_tricks.sliding_window_view(wrapped, width)


def circulant_minhash(h: np.ndarray, begin: np.ndarray, width: int, seed: int, block: int = 1 << 15) -> np.ndarray:
    """Signatures, a row for each document; UNIVERSE where it has no shingle."""
    sigma, shifted = permutations(width, seed)
    place = sigma[(h & U64(UNIVERSE - 1)).astype(np.int64)]
    n = len(begin) - 1
    out = np.full((n, width), UNIVERSE, np.uint32)
    for i, j in chunks(begin, block):
        lo, hi = int(begin[i]), int(begin[j])
        if hi == lo:
            continue
        if hi - lo > block:
            for a in range(lo, hi, block):
                np.minimum(out[i], shifted[place[a : min(a + block, hi)]].min(axis=0), out=out[i])
            continue
        full = i + np.flatnonzero(np.diff(begin[i : j + 1]))
        out[full] = np.minimum.reduceat(shifted[place[lo:hi]], begin[full] - lo, axis=0)
    return out


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    h, begin = shingles(*words(raw, offsets), k)
    return [np.unique(h[a:b]) for a, b in zip(begin[:-1], begin[1:])]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact Jaccard similarity of two sorted arrays of distinct values."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def _sign(k: int, width: int, rows: int, seed: int):
    bands = width // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = id_column(batch, "id").to_numpy(zero_copy_only=False)
            raw, offsets = string_buffers(id_column(batch, "t"))
            for i, j in chunks(offsets):
                part, offs = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                h, begin = shingles(*words(part, offs), k)
                sig = circulant_minhash(h, begin, width, seed)
                keys = np.zeros((j - i, 2), np.int64)
                for d in range(j - i):
                    own = h[begin[d] : begin[d + 1]]
                    what = np.unique(own).tobytes() if len(own) else b"raw" + part[offs[d] : offs[d + 1]].tobytes()
                    keys[d] = np.frombuffer(xxhash.xxh3_128_digest(what), np.int64)
                some = np.diff(begin) > 0
                band = np.zeros((j - i, bands), U64)
                with np.errstate(over="ignore"):
                    for c in range(rows):
                        band = (band ^ (band >> U64(31))) * U64(0x9FB21C651E98DF25) + sig[:, c : bands * rows : rows].astype(U64)
                    band = mix(band + np.arange(bands, dtype=U64) * U64(0xD1B54A32D192ED03))
                band = band.view(np.int64)
                count = np.where(some, bands, 0)
                low = (sig & np.uint32(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[i:j], pa.int64()),
                        pa.array(keys[:, 0]),
                        pa.array(keys[:, 1]),
                        pa.array([x.tobytes() for x in low], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(band[some].ravel())),
                    ],
                    names=["id", "k1", "k2", "low", "bands"],
                )

    return run


def _plausible(width: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = []
            for c in ("la", "lb"):
                raw, _ = _binary(id_column(batch, c))
                sides.append(raw.reshape(-1, width))
            share = (sides[0] == sides[1]).mean(axis=1)
            keep = pa.array((share - 1 / 256) / (1 - 1 / 256) >= least)
            yield pa.RecordBatch.from_arrays([id_column(batch, c).filter(keep) for c in ("a", "b", "n")], names=["a", "b", "n"])

    return run


def links(comps: np.ndarray, low: np.ndarray, least: float, rows: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Plausible pairs of a row and another that stand in different components, ``low`` being their signatures."""
    found: list[tuple[int, np.ndarray]] = []
    for x in rows:
        apart = others[comps[others] != comps[x]]
        share = (low[apart] == low[x]).mean(axis=1)
        found.append((x, apart[(share - 1 / 256) / (1 - 1 / 256) >= least]))
    left = np.repeat(np.array([x for x, _ in found], np.int64), [len(y) for _, y in found])
    return left, np.concatenate([y for _, y in found]) if found else left


def _links(width: int, least: float):
    """Rows arrive sorted by cell: the members of one part of a bucket, or of two."""

    def pairs(cell: int, ids: np.ndarray, comps: np.ndarray, part: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
        one, two = (np.flatnonzero(part == p) for p in (part[0], part[-1]))
        if part[0] == part[-1]:  # of both orders of a pair, one
            found = [links(comps, low, least, one[n : n + 1], one[:n]) for n in range(1, len(one))]
            x, y = (np.concatenate([f[side] for f in found] or [np.zeros(0, np.int64)]) for side in (0, 1))
        else:
            x, y = links(comps, low, least, *sorted((one, two), key=len))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), cell)), pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y]))], names=["cell", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, ids, comps, part = (id_column(batch, c).to_numpy(zero_copy_only=False) for c in ("cell", "id", "comp", "part"))
            low = _binary(id_column(batch, "low"))[0].reshape(-1, width)
            cuts = np.concatenate([[0], np.flatnonzero(cells[1:] != cells[:-1]) + 1, [len(cells)]])
            for i, j in zip(cuts[:-1], cuts[1:]):
                if cells[i] != cell:
                    if held:
                        yield pairs(cell, *(np.concatenate(c) for c in zip(*held)))
                    cell, held = cells[i], []
                held.append((ids[i:j], comps[i:j], part[i:j], low[i:j]))
        if held:
            yield pairs(cell, *(np.concatenate(c) for c in zip(*held)))

    return run


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


class Cell:
    """Exact comparison of the pairs of one cell; those that others have joined already need none."""

    def __init__(self, least: float):
        self.least, self.sets, self.parent, self.passing = least, {}, {}, None

    def root(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = self.parent[up]
            x = up
        return x

    def add(self, doc: int, own: np.ndarray, keep: bool = True) -> None:
        """A document's set; without ``keep`` it goes when the next document comes."""
        if self.passing is not None and self.passing != doc:
            del self.sets[self.passing]
        self.passing = None if keep else doc
        several = self.sets.setdefault(doc, [])
        if not any(np.array_equal(own, x) for x in several):
            several.append(own)

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        small, large = sorted((len(a), len(b)))
        return small >= self.least * large and jaccard(a, b) >= self.least

    def joins(self, a: int, b: int) -> bool:
        """Whether the two are near and weren't known to be in one group."""
        x, y = self.root(a), self.root(b)
        if x == y or not any(self.similar(p, q) for p in self.sets[a] for q in self.sets[b]):
            return False
        self.parent[x] = y
        return True


def _compare(k: int, least: float):
    """Rows arrive sorted by cell and document: its text, then its pairs with earlier documents.

    Texts are held while later documents have pairs with them, so where one
    document meets many, it alone is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, Cell(least)
        for batch in batches:
            cells, a, b, keep = (id_column(batch, c).to_pylist() for c in ("cell", "a", "b", "keep"))
            raw, offsets = string_buffers(id_column(batch, "t"))
            found: list[tuple[int, int]] = []
            for i, j in chunks(offsets):
                sets = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                for d in range(i, j):
                    if cells[d] != now:
                        now, cell = cells[d], Cell(least)
                    if b[d] is None:
                        cell.add(a[d], sets[d - i], keep[d])
                    elif cell.joins(a[d], b[d]):
                        found.append((a[d], b[d]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def _verified(texts: DataFrame, pairs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b) of the near ones among pairs (cell, a, b), but for those that others of their cell imply.

    A text goes once to each cell that has a pair of it.
    """
    end = lambda c, first: F.struct(F.col(c).alias("id"), F.lit(first).alias("first"))
    seats = pairs.select("cell", F.explode(F.array(end("a", True), end("b", False))).alias("e")).groupBy("cell", F.col("e.id").alias("id")).agg(F.max("e.first").alias("keep"))
    # always a shuffled join: the texts of candidates grow with the corpus
    members = texts.join(seats.hint("merge"), "id").select("cell", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "keep", "t")
    rows = members.union(pairs.select("cell", "a", "b", F.lit(False), F.lit(None).cast("string").alias("t")))
    return rows.repartition("cell").sortWithinPartitions("cell", F.coalesce("b", "a"), F.col("b").isNotNull(), "a").mapInArrow(_compare(k, threshold), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of the ids in ``edges`` (a, b with a < b), comp the least id.

    Large-star and small-star steps alternate until nothing changes; each makes
    a written table, and the superseded one is deleted.
    """
    known, now = None, edges
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(near, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        after = written(small, "components")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now is not edges:
            drop_written(now)
        now = after
        if state == known:
            break
        known = state
    return now.select(F.col("b").alias("id"), F.col("a").alias("comp")).union(now.select(F.col("a").alias("id"), F.col("a").alias("comp")).distinct())


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3, width: int = 128, rows: int = 3, threshold: float = 0.5, seed: int = 42, cell: int = 2048
) -> DataFrame:
    """(doc_id, group_id, kept): near-duplicate groups of all documents.

    Two documents are near duplicates if the Jaccard similarity of their sets of
    ``k``-word shingles is at least ``threshold``; groups are the connected
    components of verified pairs.  ``width // rows`` bands propose pairs, and
    those whose signatures agree far too rarely (4 standard deviations) drop out
    before the exact comparison.

    Equal shingle sets are collapsed beforehand by a 128-bit hash.  Each member
    of a bucket is compared with its first and its previous one; where that
    leaves a bucket in several groups, so are all its plausible pairs across
    them.  Pairs are compared in cells of at most two times ``cell`` documents
    of a bucket, so a crowded bucket is spread over many tasks; ``cell`` has no
    influence on the result.
    """
    spark = docs.sparkSession
    workers_import(spark)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null")
    texts = own.where("t is not null")
    sig = written(texts.mapInArrow(_sign(k, width, rows, seed), "id long, k1 long, k2 long, low binary, bands array<long>"), "signatures")
    keys = sig.groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    mapping = written(sig.select("id", "k1", "k2").join(keys, ["k1", "k2"]).groupBy("id").agg(F.min("rep").alias("rep"), F.collect_set("rep").alias("reps")), "representatives")
    reps = keys.select(F.col("rep").alias("id"))
    band = sig.select("id", "bands").join(reps, "id", "left_semi").select("id", F.explode("bands").alias("band")).distinct()
    whole = Window.partitionBy("band")
    inside = whole.orderBy("id")
    buckets = band.select("id", "band", F.first("id").over(inside).alias("hub"), F.lag("id").over(inside).alias("prev"), F.count("*").over(whole).alias("n"))
    buckets = written(buckets.where("n > 1"), "buckets")
    proposed = buckets.where("hub < id").select(F.explode(F.array_distinct(F.array("hub", "prev"))).alias("a"), F.col("id").alias("b"), "n").where("a < b")
    proposed = proposed.groupBy("a", "b").agg(F.max("n").alias("n"))
    low = sig.select("id", "low")
    sided = proposed.join(low.select(F.col("id").alias("a"), F.col("low").alias("la")), "a").join(low.select(F.col("id").alias("b"), F.col("low").alias("lb")), "b")
    least = threshold - 4 * (threshold * (1 - threshold) / width) ** 0.5
    # the partners of one document meet in as many cells as its largest bucket needs
    spread = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / F.lit(cell)))
    first = written(sided.mapInArrow(_plausible(width, least), "a long, b long, n long").distinct().select(F.xxhash64("a", spread).alias("cell"), "a", "b"), "pairs")
    # a doc_id with several texts joins what each of them equals
    implied = mapping.where(F.size("reps") > 1).select(F.col("rep").alias("a"), F.explode("reps").alias("b")).where("a < b")
    edges = written(_verified(texts, first, k, threshold).union(implied).distinct(), "edges")
    comp = components(edges)
    # a bucket of four has pairs that were not looked at; they matter where they would join two groups
    seats = buckets.where("n > 3").select("id", "band", "n").join(comp, "id", "left").select("id", "band", "n", F.coalesce("comp", "id").alias("comp"))
    seats = seats.withColumn("from", F.min("comp").over(whole)).withColumn("to", F.max("comp").over(whole)).where("from < to")
    parts = F.ceil(F.col("n") / F.lit(cell))
    seats = seats.select("id", "band", "comp", parts.alias("parts"), F.pmod(F.xxhash64("id"), parts).alias("part"))
    # every two parts of a bucket meet in a cell
    meetings = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: F.xxhash64("band", F.least(q, F.col("part")), F.greatest(q, F.col("part"))))
    mixed = seats.select("id", "comp", "part", F.explode(meetings).alias("cell")).join(low, "id").repartition("cell").sortWithinPartitions("cell", "part", "id")
    plausible = mixed.select("cell", "id", "comp", "part", "low").mapInArrow(_links(width, least), "cell long, a long, b long")
    second = plausible.groupBy("a", "b").agg(F.min("cell").alias("cell")).join(first.select("a", "b"), ["a", "b"], "left_anti").select("cell", "a", "b")
    second = written(second, "links")
    done = [buckets, first, second]
    if not second.isEmpty():
        near = _verified(texts, second, k, threshold)
        side = lambda name: comp.select(F.col("id").alias(name), F.col("comp").alias(f"{name}_comp"))
        ends = near.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
        joined = written(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "joined")
        wider = written(components(joined).select(F.col("id").alias("comp"), F.col("comp").alias("first")), "wider")
        lone = wider.join(comp.where("id = comp"), "comp", "left_anti").select(F.col("comp").alias("id"), "first")
        comp = written(comp.join(wider, "comp", "left").select("id", F.coalesce("first", "comp").alias("comp")).union(lone.select("id", F.col("first").alias("comp"))), "groups")
        done += [joined, wider]
    found = mapping.join(comp.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("id", F.coalesce("comp", "rep").alias("group_id"))
    alone = own.where("t is null").select("id").distinct().join(mapping, "id", "left_anti").select("id", F.col("id").alias("group_id"))
    for table in (sig, edges, *done):
        drop_written(table)
    return found.union(alone).select(F.col("id").alias("doc_id"), "group_id", (F.col("id") == F.col("group_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, all columns kept.

    Rows whose doc_id is null stay; rows of a doc_id that are equal in all columns become one.
    """
    id_col = options.get("id_col", "doc_id")
    gone = near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("__gone"))
    # maps can't be hashed
    parts = [F.to_json(F.struct(c)) if "map<" in kind or kind == "variant" else F.col(f"`{c}`") for c, kind in docs.dtypes]
    row = "__row" + "_" * max(map(len, docs.columns))
    known = docs.where(F.col(id_col).isNotNull()).withColumn(row, F.xxhash64(*parts))
    kept = known.join(gone, known[id_col].cast("long") == gone["__gone"], "left_anti").dropDuplicates([id_col, row]).drop(row)
    return kept.union(docs.where(F.col(id_col).isNull()))
