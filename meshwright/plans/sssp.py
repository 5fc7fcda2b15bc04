"""Single-source shortest paths, formulated three ways that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semiring import MIN_PLUS
from ..graph import Graph
from ..operators.engine import AdvanceProgram, BlasProgram, Component, run
from ..operators.frontier import DenseFrontier, SparseFrontier


class _Paths(Component):
    def __init__(self, graph: Graph, source: int):
        super().__init__(graph)
        self.source = source

    def init(self) -> DataFrame:
        kind = self.graph.edges.schema["weight"].dataType
        return self.graph.vertices.select("vid", F.when(F.col("vid") == self.source, F.lit(0)).cast(kind).alias("dist"))

    def final(self, state: DataFrame) -> DataFrame:
        return state.select("vid", "dist")


def _closer(new):
    return lambda: F.col("dist").isNull() | (F.col(new) < F.col("dist"))


def _nearest(new):
    return lambda: {"dist": F.least("dist", new)}  # least passes nulls over


def _source(graph: Graph, source, original: bool) -> int:
    return graph.find(source) if original or graph.ids is None else source


def sssp_advance(graph: Graph, source: int, *, original: bool = True, **options) -> DataFrame:
    """(vid, dist) by expanding the vertices that improved; null where unreached."""
    program = AdvanceProgram(message=lambda: F.col("dist") + F.col("weight"), reduce=F.min, update=_nearest("message"), activate=_closer("message"), relaxes="dist")
    src = _source(graph, source, original)
    found = run(_Paths(graph, src), SparseFrontier([src]), program, **options)
    return graph.original(found) if original else found


def _blas(graph: Graph, source: int, frontier: type, original: bool, **options) -> DataFrame:
    program = BlasProgram(gather=MIN_PLUS, construct=lambda: F.col("dist"), update=_nearest("result"), activate=_closer("result"), relaxes="dist")
    src = _source(graph, source, original)
    found = run(_Paths(graph, src), frontier([src]), program, **options)
    return graph.original(found) if original else found


def sssp_blas_sparse(graph: Graph, source: int, *, original: bool = True, **options) -> DataFrame:
    """The same by min-plus products over the active vertices."""
    return _blas(graph, source, SparseFrontier, original, **options)


def sssp_blas_dense(graph: Graph, source: int, *, original: bool = True, **options) -> DataFrame:
    """The same by min-plus products over all vertices, inactive ones sending nothing."""
    return _blas(graph, source, DenseFrontier, original, **options)
