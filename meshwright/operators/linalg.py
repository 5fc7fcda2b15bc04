"""Sparse and dense products as joins and aggregations.

A sparse matrix is its edges (row ``dst``, column ``src``); dense ones are long
(row, col, val) or one array a vertex.  Skewed rows are left to partial
aggregation and the adaptive planner.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semiring import PLUS_TIMES, Semiring
from .primitives import inclusive_scan, lower_bound


#: Places of an array that one aggregation sums.
SEGMENT = 64


def spmv(edges: DataFrame, x: DataFrame, semiring: Semiring = PLUS_TIMES, *, vertices: DataFrame | None = None, value: str = "val", name: str = "val") -> DataFrame:
    """y[dst] = reduce over edges of combine(weight, x[src]), as (vid, name).

    With ``vertices`` every vertex has a result, ``zero`` without edges.
    """
    met = edges.select("src", "dst", "weight").join(x.select(F.col("vid").alias("src"), F.col(value).alias("__x")), "src")
    out = met.groupBy(F.col("dst").alias("vid")).agg(semiring.reduce(semiring.combine(F.col("weight"), F.col("__x"))).alias(name))
    if vertices is None:
        return out
    filled = vertices.select("vid").join(out, "vid", "left")
    return filled if semiring.zero is None else filled.select("vid", F.coalesce(F.col(name), F.lit(semiring.zero)).alias(name))


def spmm(edges: DataFrame, b: DataFrame, semiring: Semiring = PLUS_TIMES) -> DataFrame:
    """C = A B in long form: (row, col, val), row from ``dst``, B's rows by ``src``."""
    met = edges.select("src", "dst", "weight").join(b.select(F.col("row").alias("src"), "col", "val"), "src")
    return met.groupBy(F.col("dst").alias("row"), "col").agg(semiring.reduce(semiring.combine(F.col("weight"), F.col("val"))).alias("val"))


def spmm_arrays(edges: DataFrame, features: DataFrame, width: int, column: str = "features") -> DataFrame:
    """A X with an array a vertex: (vid, column); vertices without edges have none.

    One aggregate for every place of the array keeps the partial sums map-side.
    Wide arrays are summed in segments of SEGMENT places, as Spark generates no
    code for aggregates of more than a hundred columns.
    """
    met = edges.select("src", "dst", "weight").join(features.select(F.col("vid").alias("src"), F.col(column).alias("__x")), "src")
    if width <= SEGMENT:
        sums = [F.sum(F.col("weight") * F.col("__x")[i]).alias(f"__{i}") for i in range(width)]
        return met.groupBy(F.col("dst").alias("vid")).agg(*sums).select("vid", F.array(*[f"__{i}" for i in range(width)]).alias(column))
    cut = lambda i: F.struct(F.lit(i).alias("at"), F.slice("__x", i + 1, min(SEGMENT, width - i)).alias("x"))
    each = met.select(F.col("dst").alias("vid"), "weight", F.explode(F.array(*[cut(i) for i in range(0, width, SEGMENT)])).alias("__s"))
    sums = [F.sum(F.col("weight") * F.get("__s.x", F.lit(i))).alias(f"__{i}") for i in range(SEGMENT)]
    parts = each.groupBy("vid", F.col("__s.at").alias("__at")).agg(*sums).select("vid", F.struct("__at", F.array(*[f"__{i}" for i in range(SEGMENT)]).alias("x")).alias("__s"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list("__s")), lambda s: s["x"]))
    return parts.groupBy("vid").agg(whole.alias(column)).select("vid", F.slice(column, 1, width).alias(column))


def gemm(a: DataFrame, b: DataFrame, semiring: Semiring = PLUS_TIMES, *, a_col_major: bool = False, b_col_major: bool = False) -> DataFrame:
    """C = A B of long matrices; a column-major operand has its indices the other way round."""
    rows, inner = ("col", "row") if a_col_major else ("row", "col")
    left = a.select(F.col(rows).alias("i"), F.col(inner).alias("k"), F.col("val").alias("x"))
    inner, cols = ("col", "row") if b_col_major else ("row", "col")
    right = b.select(F.col(inner).alias("k"), F.col(cols).alias("j"), F.col("val").alias("y"))
    return left.join(right, "k").groupBy(F.col("i").alias("row"), F.col("j").alias("col")).agg(semiring.reduce(semiring.combine(F.col("x"), F.col("y"))).alias("val"))


def times_small(column: Column, weights: list[list[float]]) -> Column:
    """An array times a small dense matrix that the driver holds: no join, no shuffle.

    The matrix is a model parameter, whose size doesn't depend on the data; it
    stands in the plan once, by columns.
    """
    by_column = F.array(*[F.array(*[F.lit(float(r[j])) for r in weights]) for j in range(len(weights[0]))])
    dot = lambda w: F.aggregate(F.zip_with(column, w, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return F.transform(by_column, dot)


def sddmm(edges: DataFrame, left: DataFrame, right: DataFrame, column: str = "features") -> DataFrame:
    """(src, dst, val): weight times the dot product of the ends' arrays, for each edge."""
    met = edges.select("src", "dst", "weight").join(left.select(F.col("vid").alias("src"), F.col(column).alias("__l")), "src")
    met = met.join(right.select(F.col("vid").alias("dst"), F.col(column).alias("__r")), "dst")
    dot = F.aggregate(F.zip_with("__l", "__r", lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, v: s + v)
    return met.select("src", "dst", (F.col("weight") * dot).alias("val"))


def offsets_to_indices(offsets: DataFrame) -> DataFrame:
    """(position, row) of all entries, from (row, offset) with a last row for the end."""
    rows = offsets.select(F.col("row").alias("r"), F.col("offset").alias("a")).join(offsets.select((F.col("row") - 1).alias("r"), F.col("offset").alias("z")), "r").where("z > a")
    return rows.select(F.explode(F.sequence(F.col("a"), F.col("z") - 1)).alias("position"), F.col("r").alias("row"))


def indices_to_offsets(rows: DataFrame, num_rows: int, column: str = "row") -> DataFrame:
    """(row, offset) for rows 0 to ``num_rows``: how many entries stand before each row."""
    spark = rows.sparkSession
    counts = rows.groupBy(F.col(column).alias("row")).agg(F.count("*").alias("n"))
    every = spark.range(num_rows + 1).select(F.col("id").alias("row")).join(counts, "row", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"))
    return inclusive_scan(every, "n", "upto", "row").select("row", (F.col("upto") - F.col("n")).alias("offset"))


def indices_to_offsets_by_search(rows: DataFrame, num_rows: int, column: str = "row") -> DataFrame:
    """The same by a lower-bound search of every row number."""
    wanted = rows.sparkSession.range(num_rows + 1).select(F.col("id").alias("row"))
    return lower_bound(rows, wanted, column, "row", "offset")


def row_normalised(edges: DataFrame, least: float = 1e-10) -> DataFrame:
    """Weights divided by their row's sum (rows by ``src``), sums at least ``least``."""
    sums = edges.groupBy("src").agg(F.sum("weight").alias("__s"))
    return edges.join(sums, "src").select("src", "dst", (F.col("weight") / F.greatest(F.col("__s"), F.lit(least))).alias("weight"))


def symmetrised(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """Edges, their reverses and, with ``vertices``, a loop each of weight 1; equal ones add up."""
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    all_ = edges.select(F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("e"), F.col("weight").cast("double").alias("weight")).select("e.src", "e.dst", "weight")
    if vertices is not None:
        all_ = all_.unionByName(vertices.select(F.col("vid").alias("src"), F.col("vid").alias("dst"), F.lit(1.0).alias("weight")))
    return all_.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def reduced(df: DataFrame, key: str, value: str, reduce: Callable[[Column], Column], name: str = "val") -> DataFrame:
    """Segment reduction by key."""
    return df.groupBy(key).agg(reduce(F.col(value)).alias(name))
