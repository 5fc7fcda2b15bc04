"""One pass of a graph network as a program: construct, weigh, gather, apply."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.linalg import sddmm, spmm_arrays


@dataclass(frozen=True)
class GnnProgram:
    """A layer's hooks.

    ``construct`` makes of a vertex's array the one that it sends, of ``width``
    places; with ``weigh`` an edge's weight is multiplied by the dot product of
    what its ends constructed; arrays are gathered along in-edges, and ``apply``
    makes the new array from the constructed and the gathered one, which is zeros
    without in-edges.
    """

    construct: Callable[[Column], Column]
    apply: Callable[[Column, Column], Column]
    width: int
    weigh: bool = False


def forward(program: GnnProgram, edges: DataFrame, x: DataFrame) -> DataFrame:
    """(vid, features) of every vertex of ``x`` after one pass."""
    own = x.select("vid", program.construct(F.col("features")).alias("features"))
    met = sddmm(edges, own, own).withColumnRenamed("val", "weight") if program.weigh else edges
    got = spmm_arrays(met, own, program.width).withColumnRenamed("features", "__got")
    none = F.array_repeat(F.lit(0.0), program.width)
    return own.join(got, "vid", "left").select("vid", program.apply(F.col("features"), F.coalesce("__got", none)).alias("features"))


def engine_forward(programs: list[GnnProgram], edges: DataFrame, x: DataFrame) -> DataFrame:
    """Layers one after the other."""
    for program in programs:
        x = forward(program, edges, x)
    return x
