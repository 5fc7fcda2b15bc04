"""Array functions of vertex features, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, not at every use within ``f``."""
    return F.transform(F.array(value), f)[0]


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def log_softmax(x: Column) -> Column:
    """x - max - log(sum(exp(x - max)))"""
    shift = lambda top: top + F.log(_sum(F.transform(x, lambda v: F.exp(v - top))))
    return bound(bound(F.array_max(x), shift), lambda s: F.transform(x, lambda v: v - s))


def l2_normalised(x: Column, least: float = 1e-12) -> Column:
    """Divided by the Euclidean length, at least ``least``."""
    size = F.greatest(F.sqrt(_sum(F.transform(x, lambda v: (v * v).cast("double")))), F.lit(least))
    return bound(size, lambda s: F.transform(x, lambda v: v / s))


def plus(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def argmax(x: Column) -> Column:
    """The first place of the greatest value, from 0."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == label, 1.0).otherwise(0.0))


def dropout(x: Column, rate: float, *, training: bool = False, seed: int = 0) -> Column:
    """Identity unless training; then values go with probability ``rate`` and the others are scaled up."""
    if not training or rate <= 0:
        return x
    keep = F.rand(seed) >= rate  # one draw a row: with its hash, one for every place
    return F.transform(x, lambda v, i: F.when(F.pmod(F.xxhash64(keep, i, v, F.lit(seed)), F.lit(1_000_000)) / 1e6 >= rate, v / (1 - rate)).otherwise(0.0))


def accuracy(df: DataFrame, scores: str = "scores", label: str = "label") -> DataFrame:
    """Share of rows whose greatest score is their label's."""
    return df.agg(F.avg((argmax(F.col(scores)) == F.col(label)).cast("double")).alias("accuracy"))


def splits(df: DataFrame, key: str = "vid") -> DataFrame:
    """The citation sets' fixed split by vertex number."""
    v = F.col(key)
    return df.withColumn("split", F.when(v < 140, "train").when(v.between(200, 499), "val").when(v.between(500, 1499), "test"))
