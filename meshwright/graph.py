"""Graphs as a pair of DataFrames, with declared views."""

from __future__ import annotations

import enum

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.primitives import with_index
from .sources.loader import deduplicated, load_edges, mirrored
from .sources.options import LoadOptions

EDGE_TYPES = (T.LongType, T.IntegerType)


class Views(enum.Flag):
    """Layouts that a graph keeps: edges by source, edges by target, formats."""

    NORMAL = 1
    TRANSPOSE = 2
    COO = 4
    CSR = 8

    def has_all(self, other: Views) -> bool:
        return self & other == other

    def has_some(self, other: Views) -> bool:
        return bool(self & other)

    def first(self) -> Views:
        """The highest view, which names the storage format."""
        return Views(1 << self.value.bit_length() - 1)


ADVANCE_VIEWS = Views.CSR | Views.NORMAL
BLAS_VIEWS = Views.CSR | Views.TRANSPOSE
ALL_VIEWS = Views.CSR | Views.NORMAL | Views.TRANSPOSE


class Graph:
    """Vertices (vid, ...) and edges (src, dst, weight).

    Without vertices they are all ids from 0 to the greatest in an edge, or with
    ``gaps=False`` those that edges mention.
    """

    def __init__(self, edges: DataFrame, vertices: DataFrame | None = None, *, views: Views = ALL_VIEWS, ids: DataFrame | None = None, gaps: bool = True):
        kinds = {f.name: f.dataType for f in edges.schema}
        if not {"src", "dst"} <= kinds.keys() or not all(isinstance(kinds[c], EDGE_TYPES) for c in ("src", "dst")):
            raise TypeError(f"edges need integer columns src and dst, not {edges.schema.simpleString()}")
        if "weight" not in kinds:
            edges = edges.withColumn("weight", F.lit(1.0))
        self.edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "weight")
        self.views, self.ids, self.gaps, self._own = views, ids, gaps, vertices
        self._size: Row | None = None

    @classmethod
    def from_edges(cls, edges: DataFrame, *, directed: bool = True, keep_self_loops: bool = True, keep_duplicates: bool = True, **options) -> Graph:
        """A graph of any table of edges; position counts only through a column ``pos``."""
        if not keep_self_loops:
            edges = edges.where("src <> dst")
        if not directed:
            edges = mirrored(edges)
        if not keep_duplicates:
            edges = deduplicated(edges if "pos" in edges.columns else edges.withColumn("pos", F.col("weight")))
        return cls(edges.select("src", "dst", "weight"), **options)

    @classmethod
    def load(cls, spark: SparkSession, path: str, options: LoadOptions = LoadOptions(), *, views: Views = ALL_VIEWS) -> Graph:
        edges, ids = load_edges(spark, path, options)
        return cls(edges, None if ids is None else ids.select("vid"), views=views, ids=ids)

    def _needs(self, view: Views) -> None:
        if not self.views.has_all(view):
            raise ValueError(f"the graph was declared without {view}")

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def vertices(self) -> DataFrame:
        if self._own is None:
            if self.gaps:
                self._own = self.spark.range(self.size()["num_vertices"]).select(F.col("id").alias("vid"))
            else:
                self._own = self.edges.select(F.col("src").alias("vid")).union(self.edges.select("dst")).distinct()
        return self._own

    def size(self) -> Row:
        """max_vid, num_vertices, num_edges; an empty graph has no vertices.  Counted once."""
        if self._size is None:
            self._size = self._counted()
        return self._size

    def _counted(self) -> Row:
        row = self.edges.agg(F.max(F.greatest("src", "dst")).alias("max_vid"), F.count("*").alias("num_edges")).first()
        if self._own is not None or not self.gaps:
            n = self.vertices.count()
        else:
            n = 0 if row["max_vid"] is None else row["max_vid"] + 1
        return Row(max_vid=row["max_vid"], num_vertices=n, num_edges=row["num_edges"])

    def transpose(self) -> Graph:
        return Graph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), self._own, views=self.views, ids=self.ids, gaps=self.gaps)

    def by_source(self, partitions: int | None = None) -> DataFrame:
        """Edges laid out by source: the normal view."""
        self._needs(Views.NORMAL)
        return self._laid_out("src", "dst", partitions)

    def by_target(self, partitions: int | None = None) -> DataFrame:
        """Edges laid out by target: the transposed view."""
        self._needs(Views.TRANSPOSE)
        return self._laid_out("dst", "src", partitions)

    def _laid_out(self, key: str, then: str, partitions: int | None) -> DataFrame:
        e = self.edges.repartition(partitions, key) if partitions else self.edges.repartition(key)
        return e.sortWithinPartitions(key, then)

    def adjacency(self, transpose: bool = False) -> DataFrame:
        """(vid, neighbours) with neighbours sorted by id: compressed rows."""
        self._needs(Views.TRANSPOSE if transpose else Views.NORMAL)
        key, other = ("dst", "src") if transpose else ("src", "dst")
        return self.edges.groupBy(F.col(key).alias("vid")).agg(F.array_sort(F.collect_list(F.struct(F.col(other).alias("vid"), "weight"))).alias("neighbours"))

    def _degree(self, key: str, name: str) -> DataFrame:
        counts = self.edges.groupBy(F.col(key).alias("vid")).agg(F.count("*").alias(name))
        return self.vertices.select("vid").join(counts, "vid", "left").select("vid", F.coalesce(name, F.lit(0)).alias(name))

    def out_degree(self) -> DataFrame:
        self._needs(Views.NORMAL)
        return self._degree("src", "out_degree")

    def in_degree(self) -> DataFrame:
        self._needs(Views.TRANSPOSE)
        return self._degree("dst", "in_degree")

    def out_weight(self) -> DataFrame:
        """Sum of out-edge weights; vertices without are left out."""
        return self.edges.groupBy(F.col("src").alias("vid")).agg(F.sum("weight").alias("out_weight"))

    def numbered_edges(self) -> DataFrame:
        """Edges with their number in the order of (src, dst)."""
        return with_index(self.edges, "eid", "src", "dst")

    def with_properties(self, properties: DataFrame, *, strict: bool = True) -> Graph:
        """The graph with columns attached to its vertices; strictly, one row for each."""
        joined = self.vertices.join(properties, "vid", "left")
        if strict:
            n, m = self.vertices.count(), self.vertices.join(properties, "vid").count()
            if n != m:
                raise ValueError(f"{m} rows of properties for {n} vertices")
        return Graph(self.edges, joined, views=self.views, ids=self.ids)

    def find(self, orig_id) -> int:
        """The vertex of an original id; an unknown one is an error."""
        if self.ids is not None:
            row = self.ids.where(F.col("orig_id") == F.lit(orig_id)).first()
            if row is None:
                raise KeyError(orig_id)
            return row["vid"]
        if isinstance(orig_id, int) and self.vertices.where(F.col("vid") == orig_id).limit(1).count():
            return orig_id
        raise KeyError(orig_id)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """``wanted``'s rows of ``orig_id`` with their vertex ``vid``, null where it's unknown: one join for all."""
        if self.ids is not None:
            known = self.ids.select("orig_id", "vid")
        else:
            known = self.vertices.select(F.col("vid").alias("orig_id"), "vid")
        return wanted.select("orig_id").join(known, "orig_id", "left")

    def original(self, result: DataFrame) -> DataFrame:
        """A result with original ids in place of dense ones."""
        if self.ids is None:
            return result
        rest = [c for c in result.columns if c != "vid"]
        return result.join(self.ids, "vid").select(F.col("orig_id").alias("vid"), *rest)
