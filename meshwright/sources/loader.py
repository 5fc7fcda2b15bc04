"""Edge lists, vertex files, parameters and configurations.

Lines keep their position in the file as a sortable struct (file, block, row), so
"first" means first in the file without numbering all lines.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import written
from ..operators.primitives import with_index
from .options import LoadOptions, VertexOptions

_NUMBER = r"^([+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?))"


def check_extension(path: str, ext: str) -> None:
    """An empty extension accepts any file."""
    if ext and not path.endswith(ext):
        raise ValueError(f"{path} doesn't end in {ext}")


def lines(spark: SparkSession, path: str, comment: str) -> DataFrame:
    """(line, pos): trimmed lines without blank ones and comments."""
    text = spark.read.text(path).select(
        F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"),
        F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("row")).alias("pos"),
    )
    text = text.where("line != ''")
    return text.where(~F.col("line").startswith(comment)) if comment else text


def tokens(line: Column, separators: str) -> Column:
    """Tokens between runs of any of the separators."""
    return F.filter(F.split(line, f"[{re.escape(separators)}]+"), lambda t: t != "")


def _number(token: Column, kind: str, lenient: bool) -> Column:
    if lenient:
        prefix = F.regexp_extract(token, r"^([+-]?\d+)" if kind == "long" else _NUMBER, 1)
        return F.when(token.isNotNull(), F.coalesce(prefix.try_cast(kind), F.lit(0).cast(kind)))
    return token.try_cast(kind)


def parsed_edges(spark: SparkSession, path: str, options: LoadOptions) -> DataFrame:
    """(src, dst, weight, pos) of every line, null where it can't be read."""
    check_extension(path, options.file_ext)
    parts = lines(spark, path, options.comment).select("pos", tokens(F.col("line"), options.separators).alias("p"))
    at = lambda i: F.get("p", F.lit(i))
    ident = (lambda i: at(i)) if options.string_ids else (lambda i: _number(at(i), "long", options.lenient))
    weight = F.when(at(2).isNull(), 1.0).otherwise(_number(at(2), "double", options.lenient)) if options.weighted else F.lit(1.0)
    return parts.select(ident(0).alias("src"), ident(1).alias("dst"), weight.alias("weight"), "pos")


def _readable(options: LoadOptions) -> Column:
    ok = F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("weight").isNotNull()
    return ok if options.string_ids else ok & (F.col("src") >= 0) & (F.col("dst") >= 0)


def rejected(spark: SparkSession, path: str, options: LoadOptions = LoadOptions()) -> int:
    """Lines that aren't edges: too few tokens, or ids and weights that aren't numbers."""
    return parsed_edges(spark, path, options).where(~F.coalesce(_readable(options), F.lit(False))).count()


def read_edges(spark: SparkSession, path: str, options: LoadOptions = LoadOptions()) -> DataFrame:
    """Edges (src, dst, weight, pos) as they stand, with what the options drop or shift."""
    e = parsed_edges(spark, path, options).where(_readable(options))
    if not options.keep_self_loops:
        e = e.where("src <> dst")
    if options.base_1 and not options.string_ids:
        e = e.where("src <> 0 and dst <> 0").withColumns({"src": F.col("src") - 1, "dst": F.col("dst") - 1})
    return e


def mirrored(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse; loops once.  Reverses come right after their edge."""
    extra = [c for c in edges.columns if c not in ("src", "dst", "weight", "pos")]
    place = F.col("pos") if "pos" in edges.columns else F.lit(0)
    way = lambda a, b, side: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(side).alias("side"))
    both = F.when(F.col("src") == F.col("dst"), F.array(way("src", "dst", 0))).otherwise(F.array(way("src", "dst", 0), way("dst", "src", 1)))
    each = edges.select(F.explode(both).alias("__e"), "weight", place.alias("__p"), *extra)
    return each.select("__e.src", "__e.dst", "weight", F.struct(F.col("__p").alias("p"), F.col("__e.side").alias("side")).alias("pos"), *extra)


def deduplicated(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst): the first in the file."""
    return edges.groupBy("src", "dst").agg(F.min_by("weight", "pos").alias("weight"), F.min("pos").alias("pos"))


def encounter_ids(edges: DataFrame) -> DataFrame:
    """(orig_id, vid): dense ids by first encounter, each edge's source before its target."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("end")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("end")))).alias("e"), "pos")
    first = ends.groupBy(F.col("e.id").alias("orig_id")).agg(F.min(F.struct("pos", "e.end")).alias("at"))
    return with_index(first, "vid", "at").select("orig_id", F.col("vid").cast("long").alias("vid"))


def renamed(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with dense ids; those with unknown ends go."""
    a, b = ids.select(F.col("orig_id").alias("src"), F.col("vid").alias("__s")), ids.select(F.col("orig_id").alias("dst"), F.col("vid").alias("__d"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(a, "src").join(b, "dst").select(F.col("__s").alias("src"), F.col("__d").alias("dst"), *rest)


def load_edges(spark: SparkSession, path: str, options: LoadOptions = LoadOptions()) -> tuple[DataFrame, DataFrame | None]:
    """(edges, id map or None): read, drop loops, renumber, mirror, deduplicate."""
    e, ids = read_edges(spark, path, options), None
    if options.reorder or options.string_ids:
        ids = written(encounter_ids(e), "ids")
        e = renamed(e, ids)
    if not options.directed:
        e = mirrored(e)
    if not options.keep_duplicates:
        e = deduplicated(e)
    return e.select("src", "dst", "weight"), ids


def load_vertices(spark: SparkSession, path: str, parser: Callable[[Column], dict[str, Column]], options: VertexOptions = VertexOptions(), *, ids: DataFrame | None = None, accept: Callable[[Column], Column] | None = None, raw: bool = False) -> DataFrame:
    """(vid, ...) with the columns that ``parser`` makes of a line's values.

    Values are an array of tokens, or with ``raw`` the rest of the line as it is;
    lines that ``accept`` turns down, or whose id isn't a number, are skipped.
    With ``ids`` original ids become dense ones and unknown vertices go.
    """
    check_extension(path, options.file_ext)
    sep = f"[{re.escape(options.separators)}]+"
    line = lines(spark, path, options.comment)
    if raw:
        parts = line.select(F.split("line", sep, 2).alias("p")).select(F.get("p", F.lit(0)).try_cast("long").alias("vid"), F.get("p", F.lit(1)).alias("rest"))
    else:
        parts = line.select(tokens(F.col("line"), options.separators).alias("p")).select(F.get("p", F.lit(0)).try_cast("long").alias("vid"), F.expr("slice(p, 2, greatest(size(p) - 1, 0))").alias("rest"))
    parts = parts.where("vid is not null")
    if options.base_1:
        parts = parts.where("vid <> 0").withColumn("vid", F.col("vid") - 1)
    if accept is not None:
        parts = parts.where(accept(F.col("rest")))
    out = parts.select("vid", *[c.alias(n) for n, c in parser(F.col("rest")).items()])
    if ids is not None:
        out = out.join(ids.select(F.col("orig_id").alias("vid"), F.col("vid").alias("__v")), "vid").drop("vid").withColumnRenamed("__v", "vid").select("vid", *out.columns[1:])
    return out


def numbers(kind: str = "double") -> Callable[[Column], Column]:
    """Tokens as numbers, null where they aren't."""
    return lambda t: F.transform(t, lambda x: x.try_cast(kind))


def load_vector(spark: SparkSession, path: str, num_vertices: int, options: VertexOptions = VertexOptions()) -> DataFrame:
    """(vid, val) for all vertices: 0 where the file has none."""
    found = load_vertices(spark, path, lambda t: {"val": F.get(t, F.lit(0)).try_cast("double")}, options)
    return spark.range(num_vertices).select(F.col("id").alias("vid")).join(found, "vid", "left").select("vid", F.coalesce("val", F.lit(0.0)).alias("val"))


def load_state_dict(path: str) -> dict[str, np.ndarray]:
    """Named parameters of rank 1 or 2, 32- or 64-bit numbers, from an .npz file; rank 1 becomes one row."""
    out = {}
    with np.load(path, allow_pickle=False) as f:
        for name in f.files:
            a = f[name]
            if a.dtype.kind not in "fiu" or a.dtype.itemsize not in (4, 8):
                raise TypeError(f"{name}: {a.dtype} isn't a supported type")
            if a.ndim not in (1, 2):
                raise ValueError(f"{name}: rank {a.ndim} isn't supported")
            out[name] = a.reshape(1, -1) if a.ndim == 1 else a
    return out


def load_config(path: str) -> dict:
    return json.loads(Path(path).read_text())


def load_citations(spark: SparkSession, content: str, cites: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, edges, id map) of a citation set with string ids.

    ``content`` has a paper's id, binary words and class; classes are numbered by
    first appearance.  Citations of unknown papers go; equal ones add up.
    """
    parts = lines(spark, content, "").select(F.split("line", r"\s+").alias("p"), "pos")
    parts = written(parts, "papers")
    ids = with_index(parts.select(F.get("p", F.lit(0)).alias("orig_id"), "pos"), "vid", "pos").select("orig_id", F.col("vid").cast("long").alias("vid"))
    ids = written(ids, "ids")
    label = F.element_at("p", -1)
    classes = with_index(parts.groupBy(label.alias("class")).agg(F.min("pos").alias("at")), "label", "at").select("class", F.col("label").cast("int").alias("label"))
    rows = parts.select(F.get("p", F.lit(0)).alias("orig_id"), F.expr("transform(slice(p, 2, size(p) - 2), x -> cast(x as double))").alias("features"), label.alias("class"))
    features = rows.join(ids, "orig_id").join(classes, "class").select("vid", "features", "label")
    raw = lines(spark, cites, "").select(F.split("line", r"\s+").alias("p")).select(F.get("p", F.lit(1)).alias("src"), F.get("p", F.lit(0)).alias("dst"), F.lit(1.0).alias("weight"))
    edges = renamed(raw, ids).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return features, edges, ids
