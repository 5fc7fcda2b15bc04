"""Frontiers: which vertices take part in an iteration."""

from __future__ import annotations

import enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Kind(enum.Enum):
    SPARSE = 2
    DENSE = 4
    ALL = 6


class Frontier:
    """Holds how many vertices are active; the engine keeps which in the state's column ``active``.

    ``init`` are the first active ids; :meth:`converged` ends the loop.
    """

    kind: Kind

    def __init__(self, init: list[int] | DataFrame | None = None):
        self.init, self.active = init, None

    def before_engine(self) -> None:
        """Called before every iteration."""

    def after_engine(self, active: int) -> None:
        self.active = active

    def converged(self) -> bool:
        return self.active == 0

    def initial(self, vertices: DataFrame) -> DataFrame:
        """The vertices with their first ``active``."""
        if self.init is None:
            return vertices.withColumn("active", F.lit(True))
        if isinstance(self.init, list):
            return vertices.withColumn("active", F.col("vid").isin(self.init))
        marks = self.init.select("vid").distinct().withColumn("__a", F.lit(True))
        return vertices.join(marks, "vid", "left").withColumn("active", F.col("__a").isNotNull()).drop("__a")


class SparseFrontier(Frontier):
    """A list of ids: an iteration reads the edges of the active vertices alone."""

    kind = Kind.SPARSE


class DenseFrontier(Frontier):
    """A flag of every vertex: inactive ones send the default."""

    kind = Kind.DENSE


class AllActiveFrontier(Frontier):
    """All vertices, always; first ids don't count, and the algorithm says when to end."""

    kind = Kind.ALL

    def __init__(self, init: object = None):
        super().__init__(None)

    def converged(self) -> bool:
        return False
