"""Semirings: how edges combine with values, and how results reduce.

``zero`` must be the identity of ``reduce``, and ``reduce`` associative and
commutative: partial aggregation folds in any order and grouping.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    """``combine(weight, value)`` for an edge, ``reduce`` for a row, ``zero`` for an empty row."""

    name: str
    zero: object
    combine: Callable[[Column, Column], Column]
    reduce: Callable[[Column], Column]


def folded(zero: object, f: Callable[[Column, Column], Column], kind: str = "double") -> Callable[[Column], Column]:
    """An aggregate of any associative and commutative operation.

    Collects a row's values, so it is for operations that have no aggregate.
    """
    return lambda c: F.aggregate(F.collect_list(c), F.lit(zero).cast(kind), f)


PLUS_TIMES = Semiring("plus_times", 0, lambda w, x: w * x, F.sum)
MIN_PLUS = Semiring("min_plus", None, lambda w, x: w + x, F.min)
MAX_PLUS = Semiring("max_plus", None, lambda w, x: w + x, F.max)
MAX_MIN = Semiring("max_min", None, lambda w, x: F.least(w, x), F.max)
MAX_TIMES = Semiring("max_times", None, lambda w, x: w * x, F.max)
MIN_PLUS_SUM = Semiring("min_plus_sum", 0, lambda w, x: F.least(w, x), F.sum)
OR_AND = Semiring("or_and", False, lambda w, x: (w != 0) & x, F.bool_or)
NAMED = {s.name: s for s in (PLUS_TIMES, MIN_PLUS, MAX_PLUS, MAX_MIN, MAX_TIMES, MIN_PLUS_SUM, OR_AND)}
