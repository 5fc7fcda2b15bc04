"""Relaxation within blocks of vertices, between the engine's rounds.

A round carries a value over one edge, so a graph takes as many jobs as its
paths have edges.  A block is a range of ids with at most 2 x EDGES edges among
them, kept as one row of compressed arrays; before a round every block carries its
values as far as its own edges lead, and the round takes the edges that leave
blocks.  Rounds then count the changes of block on a path.  The results are the
same, as the least sum over paths doesn't depend on the order of relaxations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.session import workers_import

#: Edges that a block should have; those beyond twice as many aren't blocks.
EDGES = 2_000_000
BLOCK = "__block"
_PACK = f"{BLOCK} int, ids binary, offsets binary, targets binary, weights binary"
#: Sums along paths have to stay below these: no overflow, and no infinities or NaN among the weights.
_MOST = {T.IntegerType: 2.0**30, T.LongType: 2.0**62, T.FloatType: 1e38, T.DoubleType: 1e307}


@dataclass(frozen=True)
class Blocks:
    """``packs``: a row of arrays for each block; ``outer``: edges between blocks; ``members``: (vid, BLOCK) of the ends of inner edges."""

    packs: DataFrame
    outer: DataFrame
    members: DataFrame

    def marked(self, state: DataFrame) -> DataFrame:
        return state.join(self.members, "vid", "left")

    def relaxed(self, state: DataFrame, column: str) -> tuple[DataFrame, bool]:
        """The checkpointed state after relaxation within blocks, and whether one has a negative cycle."""
        kind = state.schema[column].dataType.simpleString()
        values = state.where(F.col(BLOCK).isNotNull() & F.col(column).isNotNull()).select(BLOCK, "vid", F.col(column).alias("value"), "active")
        better = values.groupBy(BLOCK).cogroup(self.packs.groupBy(BLOCK)).applyInArrow(_relaxed, f"vid long, __value {kind}, __cycle boolean")
        seen = Observation()
        met = state.join(better, "vid", "left").observe(seen, F.count_if("__cycle").alias("n"))
        new = {column: F.coalesce("__value", column), "active": F.col("active") | F.col("__value").isNotNull()}
        out = met.select(*[new[c].alias(c) if c in new else F.col(c) for c in state.columns]).checkpoint()
        return out, seen.get["n"] > 0

    def unpersist(self) -> None:
        for df in (self.packs, self.outer, self.members):
            df.unpersist()


def _place(c: Column, starts: list[int], lo: int, hi: int) -> Column:
    """How many starts are at most ``c``, by halves."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(c < starts[mid], _place(c, starts, lo, mid)).otherwise(_place(c, starts, mid + 1, hi))


def blocks(edges: DataFrame, n: int, size: int | None = None) -> Blocks | None:
    """Blocks of about ``size`` out-edges each; None where there are no inner edges or sums might overflow."""
    size = size or EDGES
    most = _MOST.get(type(edges.schema["weight"].dataType))
    row = edges.agg(F.count("*").alias("m"), F.max(F.abs(F.col("weight").cast("double"))).alias("w")).first()
    if most is None or row["w"] is None or not row["w"] * (row["m"] + 1) < most:
        return None
    spark, k = edges.sparkSession, -(-row["m"] // size)
    starts = sorted({int(s) for s in edges.approxQuantile("src", [i / k for i in range(1, k)], 0.1 / k)}) if k > 1 else []
    at = lambda c: _place(F.col(c), starts, 0, len(starts))
    within = (at("src") == at("dst")) & F.col("weight").isNotNull()
    if starts:
        counts = edges.where(within).groupBy(at("src").alias("b")).agg(F.count("*").alias("m"))  # a row a block
        large = [r["b"] for r in counts.where(F.col("m") > 2 * size).collect()]
        within = within & ~at("src").isin(large) if large else within
    workers_import(spark)
    inner = edges.where(within).select(at("src").alias(BLOCK), "src", "dst", "weight")
    level = StorageLevel.MEMORY_AND_DISK
    packs = inner.groupBy(BLOCK).applyInArrow(_packed, _PACK).repartition(n, BLOCK).sortWithinPartitions(BLOCK).persist(level)
    if packs.count() == 0:
        packs.unpersist()
        return None
    members = inner.select(BLOCK, F.explode(F.array("src", "dst")).alias("vid")).distinct().persist(level)
    members.count()
    outer = edges.where(~within).persist(level)
    outer.count()
    return Blocks(packs, outer, members)


def _packed(edges: pa.Table) -> pa.Table:
    """A block's edges as compressed rows of local numbers."""
    src, dst, weight = (edges.column(c).to_numpy() for c in ("src", "dst", "weight"))
    ids = np.unique(np.concatenate([src, dst]))
    own = np.searchsorted(ids, src)
    order = np.argsort(own, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(ids)))]).astype(np.int64)
    targets = np.searchsorted(ids, dst)[order].astype(np.int32)
    data = [pa.array([a.tobytes()], pa.binary()) for a in (ids, offsets, targets, weight[order])]
    return pa.table([edges.column(BLOCK).slice(0, 1).combine_chunks(), *data], names=[BLOCK, "ids", "offsets", "targets", "weights"])


def _relaxed(values: pa.Table, pack: pa.Table) -> pa.Table:
    """(vid, value, cycle) of the vertices whose value improves."""
    kind = values.schema.field("value").type
    active = values.column("active").to_numpy() if values.num_rows else np.zeros(0, bool)
    vid, value, cycle = np.zeros(0, np.int64), np.zeros(0, kind.to_pandas_dtype()), False
    if pack.num_rows and active.any():
        read = lambda c, t: np.frombuffer(pack.column(c)[0].as_buffer(), t)
        ids, kept = read("ids", np.int64), values.column("value").to_numpy()
        far = np.inf if kept.dtype.kind == "f" else np.iinfo(kept.dtype).max
        dist, at = np.full(len(ids), far, kept.dtype), np.searchsorted(ids, values.column("vid").to_numpy())
        dist[at] = kept
        before = dist.copy()
        cycle = closure(dist, at[active.astype(bool)], read("offsets", np.int64), read("targets", np.int32), read("weights", kept.dtype))
        at = np.flatnonzero(dist < before)
        vid, value = ids[at], dist[at]
    return pa.table([pa.array(vid, pa.int64()), pa.array(value, kind), pa.array(np.full(len(vid), cycle))], names=["vid", "__value", "__cycle"])


def closure(dist: np.ndarray, start: np.ndarray, offsets: np.ndarray, targets: np.ndarray, weights: np.ndarray) -> bool:
    """Lowers ``dist`` in place along edges until nothing changes; whether a negative cycle keeps it from ending.

    Without negative weights the nearest vertices go first, within a mean weight of
    the least; else all go together, and a graph of V vertices ends within V rounds.
    """
    ordered = not len(weights) or weights.min() >= 0
    width = weights.mean().item() if len(weights) else 0
    width = width if dist.dtype.kind == "f" else int(width)
    todo, rounds = np.unique(start), 0
    while len(todo):
        if not ordered and rounds > len(dist):
            return True
        now, later = todo, todo[:0]
        if ordered and len(todo) > 1:
            d = dist[todo]
            near = d <= d.min() + width
            now, later = todo[near], todo[~near]
        lo = offsets[now]
        n = offsets[now + 1] - lo
        e = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        t, new = targets[e], np.repeat(dist[now], n) + weights[e]
        closer = new < dist[t]
        t = t[closer]
        np.minimum.at(dist, t, new[closer])
        todo = np.unique(np.concatenate([later, t]))
        rounds += 1
    return False
