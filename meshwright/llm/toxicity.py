"""Toxicity scores from an induced lexicon.

Seed terms come from labelled documents: terms far more frequent among toxic
than among clean ones, and common terms that lean to neither.  Over all
documents, terms that keep company with toxic seeds, significantly and with
several kinds of them, become nodes of a graph
whose edges are positive pointwise mutual informations of two terms' sharing a
passage.  Random walks with restart from either kind of seed give every node a
polarity; a document's score is the sum of its words' weights over the square
root of their number, the scale on which chance hits vary.

A term is a whole word or a stem (the first 4, 5 or 6 characters of a longer
word), so inflected and compounded forms share evidence.

Defined results
---------------
* a null text, or one without words, scores 0 and isn't toxic;
* without toxic or without clean labels nothing can be learnt: all scores are 0;
* an empty table gives no rows; a very long text is scored whole, passage by
  passage while learning; equal scores are treated alike, as the threshold lies
  between two scores;
* null doc_ids and repeated rows are scored like any row; labels that are null or
  whose document is missing are ignored, a document labelled both ways is toxic;
* only the named columns are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import drop_written, workers_import, written
from .neardup import _sign
from .textvec import U64, chunks, folded, id_column, mix, span_hashes, string_buffers, word_spans

STEMS = (4, 5, 6)


def terms(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each document, hashes, word index, start, end) of all terms."""
    starts, ends, first = word_spans(low, offsets)
    lead = np.flatnonzero((low & 0xC0) != 0x80)
    rank = np.searchsorted(lead, starts)
    lead = np.concatenate([lead, np.full(max(STEMS) + 1, len(low))])
    hashes, owner, begin, finish = [span_hashes(low, starts, ends)], [np.arange(len(starts))], [starts], [ends]
    for n in STEMS:
        stop = lead[rank + n]
        w = np.flatnonzero(stop < ends)
        hashes.append(mix(span_hashes(low, starts[w], stop[w]) + U64(n)))
        owner.append(w)
        begin.append(starts[w])
        finish.append(stop[w])
    return first, np.concatenate(hashes), np.concatenate(owner), np.concatenate(begin), np.concatenate(finish)


class Members:
    """Positions of hashes in a small table; a bitmap turns nearly all others away."""

    def __init__(self, table: np.ndarray):
        self.table = np.sort(table.astype(U64))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.table >> U64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices into h, positions in the table) of the hashes that are in it."""
        if not len(self.table):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[(h >> U64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.table, h[at]), len(self.table) - 1)
        ok = self.table[place] == h[at]
        return at[ok], place[ok]


def _pieces(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        raw, offsets = string_buffers(id_column(batch, "t"))
        for i, j in chunks(offsets):
            yield batch, i, j, folded(raw[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]


def _table(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _labelled_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, i, j, low, offsets in _pieces(batches):
        toxic = id_column(batch, "toxic").to_numpy(zero_copy_only=False)[i:j].astype(np.int64)
        once = id_column(batch, "once").to_numpy(zero_copy_only=False)[i:j].astype(np.int64)
        first, h, owner, _, _ = terms(low, offsets)
        if not len(h):
            continue
        # the least stem of a term's word, or the word itself, names its family
        root = h[: first[-1]].copy()
        at = np.flatnonzero(owner[first[-1] :] >= 0) + first[-1]
        root[owner[at[::-1]]] = h[at[::-1]]
        doc = np.searchsorted(first, owner, "right") - 1
        order = np.lexsort((h, doc))
        h, doc, root = h[order], doc[order], root[owner[order]]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        h, bad, one, root = h[new], toxic[doc[new]], once[doc[new]], root[new]
        names, first_at, at = np.unique(h, return_index=True, return_inverse=True)
        count = lambda w: pa.array(np.bincount(at, w).astype(np.int64))
        yield _table({"h": pa.array(names.view(np.int64)), "family": pa.array(root[first_at].view(np.int64)), "bad": count(bad * one), "n": count(one), "all_bad": count(bad), "every": count(np.ones(len(bad)))})


def _company(seeds: np.ndarray, families: np.ndarray, passage: int):
    """Rows (h, n, m, kinds): n passages with a term, m of them with a seed too, and the seeds' families as bits; h = 0 for all passages."""
    order = np.argsort(seeds)
    bit = U64(1) << (families[order] & U64(63))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Members(seeds)
        for _, _, _, low, offsets in _pieces(batches):
            first, h, owner, _, _ = terms(low, offsets)
            if not first[-1]:
                continue
            block = _passages(first, passage)
            at, place = known.find(h)
            kinds = np.zeros(block[-1] + 1, U64)
            np.bitwise_or.at(kinds, block[owner[at]], bit[place])
            # of one spelling, terms stand in the order of their passages
            order = np.argsort(h, kind="stable")
            h, block = h[order], block[owner[order]]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (block[1:] != block[:-1])
            h, own = h[new], kinds[block[new]]
            begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            columns = [h[begin].view(np.int64), np.diff(np.append(begin, len(h))), np.add.reduceat((own > 0).astype(np.int64), begin), np.bitwise_or.reduceat(own, begin).view(np.int64)]
            for c, v in zip(range(4), (0, len(kinds), int((kinds > 0).sum()), 0)):
                columns[c] = np.append(columns[c], v)
            yield _table({name: pa.array(c) for name, c in zip(("h", "n", "m", "kinds"), columns)})

    return run


def _passages(first: np.ndarray, passage: int) -> np.ndarray:
    """The passage of each word: runs of ``passage`` words of a document."""
    n = np.diff(first)
    per = (n + passage - 1) // passage
    base = np.concatenate([[0], np.cumsum(per)])[:-1]
    doc = np.repeat(np.arange(len(n)), n)
    return base[doc] + (np.arange(first[-1]) - first[doc]) // passage


def _pairs(nodes: np.ndarray, core: int, passage: int):
    """Rows (x, y, n, term): n passages with nodes x < y, with x alone (x = y), or in all (-1).

    The first ``core`` nodes, which are many in every passage, are counted in a square table.
    """
    order = np.argsort(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = Members(nodes), len(nodes)
        total, dense, names = 0, np.zeros(core * core, np.int64), {}

        def out(keys: np.ndarray, counts: np.ndarray, wide: int, term: list) -> pa.RecordBatch:
            return _table({"x": pa.array(keys // wide), "y": pa.array(keys % wide), "n": pa.array(counts), "term": pa.array(term, pa.string())})

        for _, _, _, low, offsets in _pieces(batches):
            first, h, owner, begin, finish = terms(low, offsets)
            if not first[-1]:
                continue
            block = _passages(first, passage)
            total += int(block[-1]) + 1
            at, place = known.find(h)
            if not len(at):
                continue
            place = order[place]
            fresh = {}
            for p, a in zip(*np.unique(place, return_index=True)):
                if p not in names:
                    names[int(p)] = fresh[int(p)] = low[begin[at[a]] : finish[at[a]]].tobytes().decode("utf-8", "replace")
            seen = np.unique(block[owner[at]] * size + place)
            b, p = seen // size, seen % size
            begin_b = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            many = np.diff(np.concatenate([begin_b, [len(b)]]))
            after = np.repeat(begin_b + many, many) - np.arange(len(b))  # partners: itself and those that follow in its passage
            left = np.repeat(np.arange(len(b)), after)
            right = left + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
            inner = p[right] < core
            dense += np.bincount(p[left[inner]] * core + p[right[inner]], minlength=core * core)
            keys, counts = np.unique(p[left[~inner]] * size + p[right[~inner]], return_counts=True)
            if fresh:
                yield _table({"x": pa.array(list(fresh)), "y": pa.array(list(fresh)), "n": pa.array([0] * len(fresh)), "term": pa.array(list(fresh.values()))})
            if len(keys):
                yield out(keys, counts, size, [None] * len(keys))
        keys = np.flatnonzero(dense)
        if len(keys):
            yield out(keys, dense[keys], core, [None] * len(keys))
        yield _table({"x": pa.array([-1]), "y": pa.array([-1]), "n": pa.array([total]), "term": pa.array([None], pa.string())})

    return run


def polarity(size: int, x: np.ndarray, y: np.ndarray, w: np.ndarray, positive: np.ndarray, negative: np.ndarray, restart: float = 0.15) -> np.ndarray:
    """Share of the walk from positive seeds at each node, in 0..1 (0.5: neither).

    Edge weights ``w`` are positive pointwise mutual informations; both walks
    restart at their seeds.
    """
    x, y, w = np.concatenate([x, y]), np.concatenate([y, x]), np.tile(w, 2)
    degree = np.bincount(x, w, size)
    flow = w / np.sqrt(degree[x] * degree[y])
    reached = []
    for seeds in (positive, negative):
        start = np.zeros(size)
        start[seeds] = 1 / max(1, len(seeds))
        p = start.copy()
        for _ in range(100):
            q = restart * start + (1 - restart) * np.bincount(y, flow * p[x], size)
            if np.abs(q - p).max() < 1e-12:
                break
            p = q
        reached.append(p)
    both = reached[0] + reached[1]
    return np.where(both > 0, reached[0] / np.where(both > 0, both, 1), 0.5)


@dataclass
class Lexicon:
    """Term hashes with positive weights, their spellings, and a threshold."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    names: list[str] = field(default_factory=list)
    threshold: float = float("inf")


def _scores(lex: Lexicon):
    order = np.argsort(lex.hashes)
    weights = lex.weights[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Members(lex.hashes)
        for batch, i, j, low, offsets in _pieces(batches):
            first, h, owner, _, _ = terms(low, offsets)
            at, place = known.find(h)
            best = np.zeros(int(first[-1]) + 1)
            np.maximum.at(best, owner[at], weights[place])
            sums = np.concatenate([[0], np.cumsum(best[:-1])]) if first[-1] else np.zeros(1)
            hits = np.concatenate([[0], np.cumsum(best[:-1] > 0)]) if first[-1] else np.zeros(1)
            score = (sums[first[1:]] - sums[first[:-1]]) / np.sqrt(np.maximum(np.diff(first), 1))
            out = {"doc_id": id_column(batch, "id").slice(i, j - i), "score": pa.array(np.round(score, 9)), "hits": pa.array((hits[first[1:]] - hits[first[:-1]]).astype(np.int64)), "toxic": pa.array((score > 0) & (score >= lex.threshold))}
            yield _table(out)

    return run


def scored(own: DataFrame, lex: Lexicon) -> DataFrame:
    return own.mapInArrow(_scores(lex), "doc_id long, score double, hits long, toxic boolean")


def best_threshold(score: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold of the best F1, halfway down to the next lower score."""
    values = np.unique(score[score > 0])[::-1]
    if not len(values) or not toxic.any():
        return float("inf")
    order = np.argsort(-score, kind="stable")
    caught, taken = np.cumsum(toxic[order]), np.arange(1, len(order) + 1)
    last = np.searchsorted(-score[order], -values, "right") - 1
    f1 = 2 * caught[last] / (taken[last] + toxic.sum())
    k = int(f1.argmax())
    return float((values[k] + (values[k + 1] if k + 1 < len(values) else 0)) / 2)


def _bounds(bad: str, n: str, z: float) -> tuple[Column, Column]:
    """Between which shares ``bad`` of ``n`` leaves plausible (Wilson's bounds)."""
    n = F.greatest(F.col(n), F.lit(1))
    share = F.col(bad) / n
    middle, spread = share + z * z / 2 / n, z * F.sqrt(share * (1 - share) / n + z * z / 4 / (n * n))
    return (middle - spread) / (1 + z * z / n), (middle + spread) / (1 + z * z / n)


def induce(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = 8000, passage: int = 128,
    purity: float = 0.5, z: float = 2.0, node_z: float = 3.0, shift: float = 5.0, least: int = 5, families: int = 3, negatives: int = 400, least_polarity: float = 0.9,
) -> Lexicon:
    """Learn the lexicon.

    ``labelled`` bounds the labelled documents that give seeds and threshold
    (those of least hash, whatever the corpus size; equal texts count once).
    Toxic seeds are all terms that occur mainly in toxic ones (a share above
    ``purity`` by ``z`` standard errors), plain seeds the ``negatives`` most
    frequent of those that don't.

    The company that seeds keep and the graph are counted over all documents.  A
    term becomes a node if it occurs in at least ``least`` passages with toxic
    seeds, of at least ``families`` unlike ones (so copies of one document can't
    make it), if the odds of its passages to have one are ``shift`` times those
    of any passage by ``node_z`` standard errors, and if it isn't known from the labels
    to occur mainly in clean documents.  These are counts, not shares, so rarer
    terms enter as the corpus grows.  Of the graph's edges only those with a
    positive weight, after ``shift``, leave the cluster.
    """
    workers_import(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    told = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    told = told.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(labelled)
    sample = own.join(F.broadcast(told), "id").select("id", "t", (F.col("toxic") > 0).cast("int").alias("toxic"))
    sample = written(sample, "labelled")
    # of equal and of near copies (of a Jaccard similarity above 0.7 or so), one has a say
    bands = sample.mapInArrow(_sign(3, 128, 6, 42), "id long, k1 long, k2 long, low binary, bands array<long>").select("id", F.explode("bands").alias("band"))
    earliest = bands.join(bands.groupBy("band").agg(F.min("id").alias("earliest")), "band").groupBy("id").agg(F.min("earliest").alias("earliest"))
    sample = sample.join(earliest, "id", "left").withColumn("once", F.coalesce(F.col("earliest") == F.col("id"), F.lit(False)))
    first = F.row_number().over(Window.partitionBy("id").orderBy("t")) == 1
    sample = written(sample.withColumn("once", (F.col("once") & first).cast("int")).drop("earliest"), "labelled")
    one = sample.where("once = 1").select("id", "t", "toxic")
    total, bad_total = one.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not bad_total or bad_total == total:
        return Lexicon()
    counts = sample.mapInArrow(_labelled_counts, "h long, family long, bad long, n long, all_bad long, every long")
    stats = counts.groupBy("h").agg(F.min("family").alias("family"), *(F.sum(c).alias(c) for c in ("bad", "n", "all_bad", "every")))
    low, high = _bounds("bad", "n", z)
    stats = stats.where("every > 1").select("h", "family", "bad", "n", low.alias("low"), high.alias("high"), _bounds("all_bad", "every", z)[1].alias("copied_high"))
    stats = written(stats, "terms")
    best = stats.where((F.col("n") > 1) & (F.col("low") >= purity)).select("h", "family").collect()  # of a bounded sample
    plain = stats.where((F.col("n") > 1) & (F.col("high") < purity)).orderBy(F.desc("n"), "h").limit(negatives).select("h").collect()
    if not best:
        return Lexicon()
    positive, negative, root = (np.array(x, np.int64).view(U64) for x in ([r["h"] for r in best], [r["h"] for r in plain], [r["family"] for r in best]))
    near = own.mapInArrow(_company(positive, root, passage), "h long, n long, m long, kinds long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.bit_or("kinds").alias("kinds"))
    near = written(near.where((F.col("h") == 0) | (F.col("m") >= least)), "company")
    every = near.where("h = 0").first()
    base = every["m"] / every["n"] if every else 0.0
    odds = _bounds("m", "n", node_z)[0]
    kept = near.where((F.col("h") != 0) & (F.bit_count("kinds") >= families) & (odds * (1 - base) >= shift * base * (1 - odds)))
    rows = kept.join(stats.where(F.least("high", "copied_high") < purity), "h", "left_anti").select("h").collect()
    core = np.unique(np.concatenate([positive, negative]))
    nodes = np.concatenate([core, np.setdiff1d(np.array([r["h"] for r in rows], np.int64).view(U64), core)])
    place = {int(h): i for i, h in enumerate(nodes)}
    positive, negative = (np.array([place[int(h)] for h in seeds], np.int64) for seeds in (positive, negative))
    pairs = written(own.mapInArrow(_pairs(nodes, len(core), passage), "x long, y long, n long, term string").groupBy("x", "y").agg(F.sum("n").alias("n"), F.min("term").alias("term")), "graph")
    single = pairs.where("x = y").toPandas()  # a row for each node, and one of all passages
    total = int(single["n"][single["x"] < 0].sum())
    single = single[single["x"] >= 0]
    alone, names = np.zeros(len(nodes)), [""] * len(nodes)
    alone[single["x"]] = single["n"]
    for x, term in zip(single["x"], single["term"]):
        names[x] = term
    own_n = pairs.where("x = y and x >= 0")
    ends = pairs.where("x < y and n > 2").join(own_n.select("x", F.col("n").alias("nx")), "x").join(own_n.select("y", F.col("n").alias("ny")), "y")
    edges = ends.withColumn("w", F.log(F.col("n") * float(total) / F.col("nx") / F.col("ny") / shift)).where("w > 0").select("x", "y", "w").toPandas()
    share = polarity(len(nodes), edges["x"].to_numpy(), edges["y"].to_numpy(), edges["w"].to_numpy(), positive, negative)
    # labels outweigh the walk
    share[negative] = 0
    share[positive] = np.maximum(share[positive], least_polarity)
    use = np.flatnonzero((share >= least_polarity) & (alone > 0))
    lex = Lexicon(nodes[use], 2 * share[use] - 1, [names[i] for i in use])
    held = scored(one.select("id", "t"), lex).join(one.select(F.col("id").alias("doc_id"), F.col("toxic").alias("label")), "doc_id").select("score", "label").toPandas()
    lex.threshold = best_threshold(held["score"].to_numpy(), held["label"].to_numpy() > 0)
    for table in (sample, stats, near, pairs):
        drop_written(table)
    return lex


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, score, hits, toxic) of every row of ``docs``."""
    lex = induce(docs, labels, id_col=id_col, text_col=text_col, **options)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return scored(own, lex)


def without_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; no shuffle."""
    lex = induce(docs, labels, id_col=id_col, text_col=text_col, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _scores(lex)
        for batch in batches:
            n = batch.num_rows
            seen = [pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), id_column(batch, text_col).cast(pa.string())], names=["id", "t"])]
            bad = [b.column(3) for b in judge(iter(seen))]
            yield batch.filter(pa.compute.invert(pa.chunked_array(bad, pa.bool_()).combine_chunks()))

    return docs.mapInArrow(run, docs.schema)
