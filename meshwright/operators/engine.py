"""The iteration loop and its two engines.

State is a DataFrame (vid, columns..., active), kept by ``vid`` in as many
partitions as the edges have, so that within an iteration only the messages move.
An iteration is one job: the state's checkpoint in the shared folder, which cuts
the lineage, keeps the partitioning and survives lost executors, while the active
vertices are counted on the way.  Programs that lower a column by sums of weights
are carried through whole blocks of vertices before each round (see blocks).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.semiring import Semiring
from ..functions.session import drop_checkpoint, shared_dir
from ..graph import BLAS_VIEWS, Graph, Views
from .blocks import BLOCK, Blocks, blocks
from .frontier import Frontier, Kind, SparseFrontier


SALT = "__salt"


class Component:
    """An algorithm's lifecycle; ``status`` holds the driver's scalars."""

    def __init__(self, graph: Graph):
        self.graph, self.status = graph, {}

    def init(self) -> DataFrame:
        """The first state: (vid, columns...)."""
        raise NotImplementedError

    def converged(self, state: DataFrame) -> bool:
        return False

    def before_engine(self) -> None:
        """Called before every iteration."""

    def after_engine(self, state: DataFrame) -> None:
        """Called after every iteration."""

    def final(self, state: DataFrame) -> DataFrame:
        return state

    def measures(self) -> dict[str, Column]:
        """Aggregates of the new state, computed in the iteration's own job, for ``status``."""
        return {}


@dataclass(frozen=True)
class AdvanceProgram:
    """Expansion of a sparse frontier along out-edges.

    ``message`` is what an edge sends, from the source's columns and ``weight``;
    ``advance`` which edges send at all; ``reduce`` joins a target's messages to
    ``message``; ``update`` gives the new columns and ``activate`` the new flag
    from the old ones and ``message``; targets for which ``drop`` holds are left
    out of the next frontier.  ``relaxes`` names the column that the program does
    nothing but lower to the least of itself plus ``weight`` over in-edges, if so.
    """

    message: Callable[[], Column]
    reduce: Callable[[Column], Column]
    update: Callable[[], dict[str, Column]]
    activate: Callable[[], Column]
    advance: Callable[[], Column] | None = None
    drop: Callable[[], Column] | None = None
    relaxes: str | None = None


@dataclass(frozen=True)
class BlasProgram:
    """A semiring product over in-edges.

    ``construct`` makes a vertex's value, ``default_info`` stands in for inactive
    ones; ``gather`` is the product; a result that equals ``default_result``
    isn't applied, unless all vertices are always active; ``update`` and
    ``activate`` see the columns and ``result``; ``relaxes`` as in
    :class:`AdvanceProgram`.
    """

    gather: Semiring
    construct: Callable[[], Column]
    update: Callable[[], dict[str, Column]]
    activate: Callable[[], Column]
    default_info: object = None
    default_result: object = None
    relaxes: str | None = None


def _sent(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Edges with their source's columns; salted edges meet a copy of them for each salt."""
    if SALT not in edges.columns:
        return edges.join(values, "src")
    salts = edges.schema[SALT].metadata["salts"]
    return edges.join(values.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["src", SALT]).drop(SALT)


def _rest(state: DataFrame, *without: str) -> list[str]:
    return [c for c in state.columns if c not in ("vid", *without)]


def advance(edges: DataFrame, frontier: DataFrame, predicate: Column | None = None) -> DataFrame:
    """One expansion: the out-edges of the frontier's vertices, with their columns."""
    met = _sent(edges, frontier.withColumnRenamed("vid", "src"))
    return met if predicate is None else met.where(predicate)


def advance_step(edges: DataFrame, state: DataFrame, program: AdvanceProgram) -> DataFrame:
    sent = advance(edges, state.where("active").drop("active"), None if program.advance is None else program.advance())
    got = sent.select(F.col("dst").alias("vid"), program.message().alias("message")).groupBy("vid").agg(program.reduce(F.col("message")).alias("message"))
    return _applied(state, got, program.update(), program.activate() & F.col("message").isNotNull(), program.drop)


def _applied(state: DataFrame, got: DataFrame, update: dict[str, Column], active: Column, drop: Callable[[], Column] | None = None) -> DataFrame:
    met = state.drop("active").join(got, "vid", "left")
    keep = F.coalesce(active, F.lit(False))
    if drop is not None:
        keep = keep & ~F.coalesce(drop(), F.lit(False))
    return met.select("vid", *[update[c].alias(c) if c in update else F.col(c) for c in _rest(state, "active")], keep.alias("active"))


def blas_step(edges: DataFrame, state: DataFrame, program: BlasProgram, kind: Kind) -> DataFrame:
    g = program.gather
    if kind is Kind.SPARSE:
        x = state.where("active").select(F.col("vid").alias("src"), program.construct().alias("__x"))
    elif kind is Kind.DENSE:
        x = state.select(F.col("vid").alias("src"), F.when(F.col("active"), program.construct()).otherwise(F.lit(program.default_info)).alias("__x"))
    else:
        x = state.select(F.col("vid").alias("src"), program.construct().alias("__x"))
    got = _sent(edges, x).groupBy(F.col("dst").alias("vid")).agg(g.reduce(g.combine(F.col("weight"), F.col("__x"))).alias("result"))
    if kind is Kind.ALL:
        zero = F.lit(g.zero)
        met = state.drop("active").join(got, "vid", "left").withColumn("result", F.coalesce("result", zero) if g.zero is not None else F.col("result"))
        update = program.update()
        return met.select("vid", *[update[c].alias(c) if c in update else F.col(c) for c in _rest(state, "active")], F.lit(True).alias("active"))
    default = F.lit(program.default_result)
    changed = got.where(~F.col("result").eqNullSafe(default))
    applies = F.col("result").isNotNull()
    update = {c: F.when(applies, e).otherwise(F.col(c)) for c, e in program.update().items()}
    return _applied(state, changed, update, program.activate() & applies)


class DivergedError(RuntimeError):
    """The loop didn't end within its greatest number of iterations."""


def run(component: Component, frontier: Frontier, program: AdvanceProgram | BlasProgram, *, max_iterations: int | None = None, fixed_iterations: int | None = None, partitions: int | None = None, salts: int = 1, block_edges: int | None = None) -> DataFrame:
    """Iterate until frontier or component converge; at least once.

    With ``salts`` the out-edges of a vertex lie in so many partitions, for graphs
    with vertices of more out-edges than a partition should hold; active vertices
    are copied to each.

    ``max_iterations`` defaults to the number of vertices and a final round that
    changes nothing; beyond it the loop diverges, as it does on a negative cycle.

    A program that ``relaxes`` a column does so within blocks of about
    ``block_edges`` edges before each round, unless iterations are fixed; its
    rounds are then fewer than the edges of its longest path.
    """
    graph, spark = component.graph, component.graph.spark
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    advancing = isinstance(program, AdvanceProgram)
    if advancing and frontier.kind is not Kind.SPARSE:
        raise ValueError("the advance engine takes a sparse frontier")
    if not advancing and not graph.views.has_some(BLAS_VIEWS & ~Views.CSR | Views.NORMAL):
        raise ValueError("the graph has neither view of its edges")
    # by source: that's the side on which state joins, so edges never move again
    edges = graph.edges.repartition(n, "src").sortWithinPartitions("src")
    if salts > 1:
        edges = graph.edges.withColumn(SALT, F.pmod(F.xxhash64("dst"), F.lit(salts)).cast("int")).withMetadata(SALT, {"salts": salts}).repartition(n, "src", SALT).sortWithinPartitions("src", SALT)
    edges = edges.persist(StorageLevel.MEMORY_AND_DISK)
    edges.count()
    shared_dir(spark)  # where checkpoints go
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    # an adaptive plan's partitioning isn't known to the next one; without, the state stays where it is
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    inner = None
    try:
        if program.relaxes is not None and fixed_iterations is None and frontier.kind is not Kind.ALL:
            inner = blocks(edges, n, block_edges)
        if inner is not None:
            edges.unpersist()
            edges = inner.outer
        state = _loop(component, frontier, program, edges, n, max_iterations, fixed_iterations, inner)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        edges.unpersist()
        if inner is not None:
            inner.unpersist()
    return component.final(state.drop(BLOCK))


def _loop(component: Component, frontier: Frontier, program: AdvanceProgram | BlasProgram, edges: DataFrame, n: int, most: int | None, fixed: int | None, inner: Blocks | None) -> DataFrame:
    state = frontier.initial(component.init())
    state = (state if inner is None else inner.marked(state)).repartition(n, "vid").checkpoint()
    rounds = 0
    while True:
        component.before_engine()
        frontier.before_engine()
        if inner is not None:
            before = state
            state, cycle = inner.relaxed(state, program.relaxes)
            drop_checkpoint(before)
            if cycle:
                raise DivergedError("a negative cycle")
        stepped = advance_step(edges, state, program) if isinstance(program, AdvanceProgram) else blas_step(edges, state, program, frontier.kind)
        rounds += 1
        seen, before = Observation(), state
        state = stepped.observe(seen, F.count_if("active").alias("active"), F.count("*").alias("n"), *[c.alias(m) for m, c in component.measures().items()]).checkpoint()
        row = seen.get
        drop_checkpoint(before)
        frontier.after_engine(row["active"])
        component.status |= row | {"rounds": rounds}
        component.after_engine(state)
        if fixed is not None:
            if rounds >= fixed:
                return state
        elif frontier.converged() or component.converged(state):
            return state
        elif rounds >= (most if most is not None else row["n"] + 1):
            raise DivergedError(f"not converged after {rounds} iterations")


def activated(state: DataFrame) -> DataFrame:
    """How many vertices are active."""
    return state.agg(F.count_if("active").alias("n_active"))


def frontier_degree_sum(graph: Graph, frontier: DataFrame) -> DataFrame:
    """The size of an expansion: the sum of out-degrees over the frontier."""
    return graph.edges.join(frontier.select(F.col("vid").alias("src")), "src", "left_semi").agg(F.count("*").alias("size"))


__all__ = ["AdvanceProgram", "BlasProgram", "Component", "DivergedError", "SparseFrontier", "activated", "advance", "advance_step", "blas_step", "frontier_degree_sum", "run"]
