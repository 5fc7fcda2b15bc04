"""Mixing sources to target weights by cube-method balanced sampling.

Every document has an inclusion probability, that of its source.  The flight
phase moves the probabilities of three documents of one source at a time along
the null space of its two balancing equations (token total, document total)
until one of them is 0 or 1; expectations stay as they are.  Buckets of documents,
chosen by a hash of the doc_id, fly on their own and keep at most two undecided
documents a source; these fly again by source, and those that remain land together:
first with the equations over all sources (in buckets again while they are many),
then without the token equation, the last by its probability alone.  The draw
depends on the documents and the seed, not on partitions.

Defined results
---------------
* a document is a distinct doc_id (repeated rows count once, by their least
  source and most tokens); rows whose doc_id is null take no part;
* a null source is a source of its own; null, empty and blank texts have no
  tokens and are balanced by number alone; a very long text is one document, and
  its source's token total is met to within the longest undecided one;
* documents of equal length are told apart by doc_id, which only orders the flight;
* an empty table gives no rows; with no tokens at all every probability is the
  budget share;
* other columns are kept or not read, whatever their names.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import workers_import, written
from .textvec import id_column

_EPS = 1e-9
_ROWS = "doc_id long, source string, n_tokens long, probability double, state double"
#: Documents that fly together.
BUCKET = 1 << 15


def token_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null and blank texts.

    One split; the empty piece before leading white space and the one after
    trailing white space don't count.
    """
    blank = lambda c: F.coalesce(c.rlike(r"^\s"), F.lit(False)).cast("int")
    pieces = F.size(F.split(text, r"\s+")) - blank(F.left(text, F.lit(1))) - blank(F.right(text, F.lit(1)))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(pieces).cast("long")


def probabilities(sources: DataFrame, share: float) -> DataFrame:
    """(source, probability), of sources (source, tokens, weight), of which there may be many.

    The budget is ``share`` of all tokens, divided by weight; a source that has
    less than its part gives everything, and the others take up the rest.  Sums
    are decimal, so that their order doesn't matter.
    """
    weight = F.col("weight").cast("decimal(38,10)")
    total, weights = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.sum(weight)).first()
    if not total:
        return sources.select("source", F.lit(float(share)).alias("probability"))
    scale, known = share * total / max(float(weights or 0), 1e-300), None
    while True:
        # the more is left by those that give everything, the more do
        full = F.col("weight") * F.lit(scale) >= F.col("tokens")
        state = sources.agg(F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)), F.sum(F.when(~full, weight))).first()
        if state == known or not state[1]:
            break
        scale, known = max(scale, (share * total - state[0]) / float(state[1])), state
    return sources.select("source", F.when((F.col("tokens") <= 0) | full, F.lit(1.0)).otherwise(F.col("weight") * F.lit(scale) / F.col("tokens")).alias("probability"))


class Flight:
    """The flight phase over documents that arrive one at a time."""

    def __init__(self, rng: random.Random):
        self.rng, self.window = rng, []

    def _move(self, u: tuple[float, ...]) -> list:
        """Go to one end of the segment through the state along ``u``."""
        up = down = float("inf")
        for w, v in zip(self.window, u):
            if v > 0:
                up, down = min(up, (1 - w[1]) / v), min(down, w[1] / v)
            elif v < 0:
                up, down = min(up, w[1] / -v), min(down, (1 - w[1]) / -v)
        step = up if self.rng.random() * (up + down) < down else -down
        done, keep = [], []
        for w, v in zip(self.window, u):
            w[1] += step * v
            if w[1] <= _EPS or w[1] >= 1 - _EPS:
                w[1] = float(w[1] > 0.5)
                done.append(w)
            else:
                keep.append(w)
        self.window = keep
        return done

    def add(self, tokens: float, state: float, what) -> list:
        """Take in a document; gives those that are decided, as [tokens, state, what]."""
        unit = [tokens, state, what]
        if state <= _EPS or state >= 1 - _EPS:
            unit[1] = float(state > 0.5)
            return [unit]
        self.window.append(unit)
        if len(self.window) < 3:
            return []
        (a, _, _), (b, _, _), (c, _, _) = self.window
        u = (b - c, c - a, a - b)
        return self._move(u if any(u) else (1.0, -1.0, 0.0))

    def land(self) -> list:
        """Decide the rest: by number while two remain, then by chance."""
        done = []
        while len(self.window) > 1:
            done += self._move((1.0, -1.0) + (0.0,) * (len(self.window) - 2))
        for w in self.window:
            w[1] = float(self.rng.random() < w[1])
            done.append(w)
        self.window = []
        return done


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _ROWS.split(", ")])


def _fly(seed: int, apart: bool):
    """Flights of rows sorted by bucket: of each source on its own, or of all together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flights: dict[str | None, Flight] = {}
        now, out = None, []

        def rest() -> list:
            return [(w[2][0], w[2][2], w[0], w[2][1], w[1]) for f in flights.values() for w in f.window]

        for batch in batches:
            for bucket, doc, source, n, p, state in zip(*(id_column(batch, c).to_pylist() for c in ("bucket", "doc_id", "source", "n_tokens", "probability", "state"))):
                if bucket != now:
                    out += rest()
                    now, flights = bucket, {}
                key = source if apart else None
                if key not in flights:
                    flights[key] = Flight(random.Random(f"{seed} {key} {doc}"))
                out += [(w[2][0], w[2][2], w[0], w[2][1], w[1]) for w in flights[key].add(n, state, (doc, p, source))]
            if out:
                yield _batch(out)
                out = []
        out += rest()
        if out:
            yield _batch(out)

    return run


def landed(rows: Iterable, seed: int) -> list[tuple]:
    """Decisions for the few undecided documents of all sources."""
    flight, out = Flight(random.Random(f"{seed} landing")), []
    for r in sorted(rows, key=lambda r: (-r["n_tokens"], r["doc_id"])):
        out += flight.add(r["n_tokens"], r["state"], (r["doc_id"], r["source"], r["probability"]))
    out += flight.land()
    return [(w[2][0], w[2][1], w[0], w[2][2], w[1]) for w in out]


def mixed(
    docs: DataFrame, weights: dict[str | None, float] | None = None, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    share: float = 0.75, power: float = 0.5, seed: int = 42,
) -> DataFrame:
    """(doc_id, source, n_tokens, probability, selected) of every document.

    ``weights`` are the target weights of the sources, by default their token
    totals to the given ``power``; ``share`` of all tokens is selected.
    """
    spark = docs.sparkSession
    workers_import(spark)
    units = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), token_count(F.col(text_col).cast("string")).alias("n_tokens"))
    units = written(units.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens")), "units")
    sources = units.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    if weights is None:
        sources = sources.withColumn("weight", F.pow(F.col("tokens").cast("double"), F.lit(power)))
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "s string, weight double")
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    chance = written(probabilities(written(sources, "sources"), share), "probabilities").withColumnRenamed("source", "s")
    # no hint: sources may be as many as domains, and Spark knows the size of a written table
    ready = units.join(chance, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "n_tokens", "probability", F.col("probability").alias("state"))

    def flown(rows: DataFrame, bucket: Column, seed: int, apart: bool = True) -> DataFrame:
        # long documents first, so that the undecided ones are short and land close to the totals
        order = rows.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", F.desc("n_tokens"), "doc_id")
        return written(order.mapInArrow(_fly(seed, apart), _ROWS), "flown")

    def of(count: int) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-count // BUCKET))))

    open_ = (F.col("state") > 0) & (F.col("state") < 1)
    parts = [flown(ready, of(units.count()), seed)]
    parts.append(flown(parts[-1].where(open_), F.xxhash64("source"), seed + 1))
    while (left := parts[-1].where(open_).count()) > BUCKET:
        parts.append(flown(parts[-1].where(open_), of(left), seed + len(parts), False))
    last = spark.createDataFrame(landed(parts[-1].where(open_).collect(), seed), _ROWS)  # at most BUCKET rows
    every = last
    for part in parts:
        every = every.union(part.where(~open_))
    return every.select("doc_id", "source", "n_tokens", "probability", (F.col("state") == 1).alias("selected"))


def mixture(docs: DataFrame, weights: dict[str | None, float] | None = None, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are selected, all columns kept."""
    chosen = mixed(docs, weights, id_col=id_col, **options).where("selected").select(F.col("doc_id").alias("__chosen"))
    return docs.join(chosen.hint("merge"), docs[id_col].cast("long") == chosen["__chosen"], "left_semi")
