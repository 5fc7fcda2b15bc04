"""Weighted PageRank.

r'(v) = (1 - alpha) / V + sum over in-edges of alpha r(u) w / sum of u's weights.
Vertices without out-edges keep their mass to themselves, so ranks may sum to
less than one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semiring import PLUS_TIMES
from ..graph import Graph
from ..operators.engine import BlasProgram, Component, run
from ..operators.frontier import AllActiveFrontier


class _Ranks(Component):
    def __init__(self, graph: Graph, alpha: float, eps: float):
        super().__init__(graph)
        self.alpha, self.eps = alpha, eps
        self.vertices = graph.vertices.select("vid").cache()
        self.n = self.vertices.count()

    def init(self) -> DataFrame:
        sums = self.graph.out_weight()
        start = 1.0 / max(1, self.n)
        return self.vertices.join(sums, "vid", "left").select("vid", F.col("out_weight").cast("double").alias("out_weight"), F.lit(start).alias("rank"), F.lit(0.0).alias("previous"))

    def measures(self) -> dict[str, Column]:
        return {"difference": F.max(F.abs(F.col("rank") - F.col("previous")))}

    def converged(self, state: DataFrame) -> bool:
        return self.n == 0 or self.status["difference"] <= self.eps


def pagerank(graph: Graph, *, alpha: float = 0.85, eps: float = 1e-6, iterations: int | None = None, result: str = "latest", compat: bool = False, original: bool = True, **options) -> DataFrame:
    """(vid, rank) when no rank moves by more than ``eps``, or after ``iterations``.

    ``result="previous"`` gives the ranks before the last pass.  With ``compat``
    convergence is tested against zero before the first pass, so that a graph of
    1 / eps vertices or more keeps its uniform ranks.
    """
    own = _Ranks(graph, alpha, eps)
    if compat and own.n and 1.0 / own.n <= eps:
        done = own.vertices.select("vid", F.lit(1.0 / own.n).alias("rank"))
        return graph.original(done) if original else done
    program = BlasProgram(
        gather=PLUS_TIMES,
        construct=lambda: F.col("rank") * alpha / F.col("out_weight"),
        update=lambda: {"rank": F.lit((1 - alpha) / max(1, own.n)) + F.col("result"), "previous": F.col("rank")},
        activate=lambda: F.lit(True),
    )
    state = run(own, AllActiveFrontier(), program, fixed_iterations=iterations, max_iterations=options.pop("max_iterations", 10_000), **options)
    own.vertices.unpersist()
    ranks = state.select("vid", F.col("rank" if result == "latest" else "previous").alias("rank"))
    return graph.original(ranks) if original else ranks
