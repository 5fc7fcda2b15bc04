"""Data-parallel primitives over DataFrames: scans, ranks, scatters, searches.

Nothing here sorts into one partition: global orders are range partitions sorted
on their own, with one number a partition carried from each to the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import written


def ordered(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` in global order with __part and __row, its place; written once."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    sorted_ = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    row = F.monotonically_increasing_id()
    return written(sorted_.select("*", F.shiftright(row, 33).alias("__part"), row.bitwiseAND((1 << 33) - 1).alias("__row")), "ordered")


def with_index(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """Consecutive numbers from 0 in the given order."""
    placed = ordered(df, *order)
    counts = placed.groupBy("__part").agg(F.count("*").alias("n"))  # a row a partition
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), F.col("__part") == F.col("__p")).withColumn(name, F.col("__start") + F.col("__row")).drop("__part", "__row", "__p", "__start")


def inclusive_scan(df: DataFrame, value: str, name: str, *order: str | Column, reduce: Callable[[Column], Column] = F.sum, combine: Callable[[Column, Column], Column] = lambda a, b: a + b) -> DataFrame:
    """Running reduction of ``value`` in the given order (sum by default).

    ``reduce`` is the aggregate and ``combine`` joins two of its results.
    """
    placed = ordered(df, *order)
    totals = placed.groupBy("__part").agg(reduce(F.col(value)).alias("__t"))
    before = reduce(F.col("__t")).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.select(F.col("__part").alias("__p"), before.alias("__before"))
    inside = reduce(F.col(value)).over(Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0))
    joined = placed.withColumn("__own", inside).join(F.broadcast(carried), F.col("__part") == F.col("__p"))
    both = F.when(F.col("__before").isNull(), F.col("__own")).when(F.col("__own").isNull(), F.col("__before")).otherwise(combine(F.col("__before"), F.col("__own")))
    return joined.withColumn(name, both).drop("__part", "__row", "__p", "__before", "__own")


def lower_bound(values: DataFrame, queries: DataFrame, value: str, query: str, name: str = "position") -> DataFrame:
    """For every row of ``queries``, how many values are less: one shared sort.

    Equal values are counted beforehand, so repeated ones cost nothing in the sort.
    """
    both = queries.select(F.struct("*").alias("__q"), F.col(query).alias("__v"), F.lit(0).cast("long").alias("__n")).unionByName(
        values.groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n")).select(F.lit(None).cast(queries.select(F.struct("*")).schema[0].dataType).alias("__q"), "__v", "__n")
    )
    return inclusive_scan(both, "__n", name, "__v", "__n").where(F.col("__q").isNotNull()).select("__q.*", F.col(name).cast("long").alias(name))


def copy_if(df: DataFrame, stencil: Column) -> DataFrame:
    return df.where(stencil)


def fill(df: DataFrame, name: str, value: object) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def scatter(domain: DataFrame, values: DataFrame, key: str, value: str, default: object, stencil: Column | None = None) -> DataFrame:
    """(key, value) of all of ``domain``: from ``values`` where the stencil holds, else ``default``."""
    own = (values.where(stencil) if stencil is not None else values).select(key, value)
    return domain.select(key).join(own, key, "left").select(key, F.coalesce(F.col(value), F.lit(default)).alias(value))


def sort_by_key(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.orderBy(*keys)


def transform(a: DataFrame, b: DataFrame, key: str, name: str, f: Callable[[Column, Column], Column], va: str, vb: str) -> DataFrame:
    """Elementwise combination of two vectors by key."""
    return a.select(key, F.col(va).alias("__a")).join(b.select(key, F.col(vb).alias("__b")), key).select(key, f(F.col("__a"), F.col("__b")).alias(name))


def transform_reduce(df: DataFrame, expression: Column, reduce: Callable[[Column], Column], name: str = "result") -> DataFrame:
    return df.agg(reduce(expression).alias(name))


def max_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """The greatest absolute difference of two vectors."""
    return transform(a, b, key, "d", lambda x, y: F.abs(x - y), value, value).agg(F.max("d").alias("max_diff"))


def for_each(df: DataFrame, f: Callable) -> None:
    df.foreachPartition(f)
