"""Graph queries over the driver's tables, with their SQL."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semiring as S
from ..functions import tensor
from ..functions.session import shared_dir, written
from ..gnn.engine import GnnProgram, engine_forward
from ..gnn.gcn import GCN, GraphConvolution, full_gcn, module_forward, propagation
from ..gnn.module import build_module
from ..graph import ADVANCE_VIEWS, ALL_VIEWS, BLAS_VIEWS, Graph, Views
from ..operators import linalg as L
from ..operators import primitives as P
from ..operators.engine import AdvanceProgram, activated, advance, advance_step, frontier_degree_sum
from ..sources.loader import check_extension, deduplicated, encounter_ids, load_citations, load_edges, load_vector, load_vertices, mirrored, numbers, rejected, renamed
from ..sources.onnx import load_initializers
from ..sources.options import LoadOptions
from ..sources.sinks import text_lines
from .pagerank import pagerank
from .sssp import sssp_advance, sssp_blas_dense, sssp_blas_sparse
from .tables import SUPPLIERS, event_steps, features, supply, table, trade, transition, transition_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_STEPS = "st AS (SELECT * FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, CAST(round(value * 100) AS BIGINT) AS weight, ts, event_id FROM events) WHERE dst IS NOT NULL)"
_EDGES = f"{_STEPS}, e AS (SELECT src, dst, min(weight) AS weight FROM st WHERE src <> dst GROUP BY src, dst)"
_VERTICES = f"{_EDGES}, v AS (SELECT unnest(range((SELECT max(greatest(src, dst)) + 1 FROM e))) AS vid)"
_NUMBERED = f"{_EDGES}, ne AS (SELECT *, row_number() OVER (ORDER BY src, dst) - 1 AS eid FROM e)"
_X = "x AS (SELECT vec_id AS vid, CAST(unnest(range(len(embedding))) AS BIGINT) AS k, CAST(unnest(embedding) AS DOUBLE) AS val, label FROM embeddings)"


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is any."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# --- graph construction


@query(f"WITH {_STEPS} SELECT src, dst, arg_min(weight, (ts, event_id)) AS weight FROM st GROUP BY src, dst")
def edges_dedup(spark, sf_dir):
    return deduplicated(event_steps(spark, sf_dir)).select("src", "dst", "weight")


@query(f"WITH {_EDGES} SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e WHERE src <> dst")
def edges_mirror(spark, sf_dir):
    return mirrored(transition(spark, sf_dir)).select("src", "dst", "weight")


@query(f"WITH {_STEPS} SELECT src, dst, weight FROM st WHERE src <> dst")
def drop_self_loops(spark, sf_dir):
    path = _as_text(event_steps(spark, sf_dir), "concat(src, ' ', dst, ' ', weight)", "edges-loops")
    return load_edges(spark, path, LoadOptions(directed=True, keep_duplicates=True))[0].withColumn("weight", F.col("weight").cast("long"))


@query(f"""WITH {_STEPS}, ends AS (SELECT src AS id, ts, event_id, 0 AS s FROM st WHERE src <> dst UNION ALL SELECT dst, ts, event_id, 1 FROM st WHERE src <> dst),
f AS (SELECT id, min((ts, event_id, s)) AS seen FROM ends GROUP BY id) SELECT id AS orig_id, row_number() OVER (ORDER BY seen) - 1 AS vid FROM f""")
def densify_ids(spark, sf_dir):
    return encounter_ids(event_steps(spark, sf_dir).where("src <> dst"))


@query(f"WITH {_EDGES} SELECT max(greatest(src, dst)) AS max_vid, max(greatest(src, dst)) + 1 AS num_vertices, count(*) AS num_edges FROM e")
def graph_size(spark, sf_dir):
    return spark.createDataFrame([transition_graph(spark, sf_dir).size()], "max_vid long, num_vertices long, num_edges long")


@query(f"WITH {_VERTICES} SELECT v.vid, count(e.src) AS out_degree FROM v LEFT JOIN e ON e.src = v.vid GROUP BY v.vid")
def out_degree(spark, sf_dir):
    return transition_graph(spark, sf_dir).out_degree()


@query(f"WITH {_VERTICES} SELECT v.vid, count(e.src) AS in_degree FROM v LEFT JOIN e ON e.dst = v.vid GROUP BY v.vid")
def in_degree(spark, sf_dir):
    return transition_graph(spark, sf_dir).in_degree()


@query(f"WITH {_EDGES} SELECT src AS vid, CAST(sum(weight) AS BIGINT) AS out_weight FROM e GROUP BY src")
def out_weight(spark, sf_dir):
    return transition_graph(spark, sf_dir).out_weight()


@query(f"WITH {_EDGES} SELECT dst AS src, src AS dst, weight FROM e")
def transpose(spark, sf_dir):
    return transition_graph(spark, sf_dir).transpose().edges


@query(f"WITH {_EDGES} SELECT src AS vid, count(*) AS n, min(dst) AS first_dst, max(dst) AS last_dst FROM e GROUP BY src")
def adjacency_len(spark, sf_dir):
    a = transition_graph(spark, sf_dir).adjacency()
    return a.select("vid", F.size("neighbours").cast("long").alias("n"), F.col("neighbours")[0]["vid"].alias("first_dst"), F.element_at("neighbours", -1)["vid"].alias("last_dst"))


@query(f"WITH {_VERTICES}, r AS (SELECT vid FROM v UNION ALL SELECT max(vid) + 1 FROM v) SELECT r.vid AS row, count(e.src) AS \"offset\" FROM r LEFT JOIN e ON e.src < r.vid GROUP BY r.vid")
def row_offsets(spark, sf_dir):
    g = transition_graph(spark, sf_dir)
    return L.indices_to_offsets(g.edges, g.size()["num_vertices"], "src")


@query(f"WITH {_VERTICES}, r AS (SELECT vid FROM v UNION ALL SELECT max(vid) + 1 FROM v) SELECT r.vid AS row, count(e.src) AS \"offset\" FROM r LEFT JOIN e ON e.dst < r.vid GROUP BY r.vid")
def column_offsets(spark, sf_dir):
    g = transition_graph(spark, sf_dir)
    return L.indices_to_offsets_by_search(g.edges, g.size()["num_vertices"], "dst")


@query(f"WITH {_NUMBERED} SELECT eid AS position, src AS row FROM ne")
def offsets_to_indices(spark, sf_dir):
    g = transition_graph(spark, sf_dir)
    return L.offsets_to_indices(L.indices_to_offsets(g.edges, g.size()["num_vertices"], "src"))


@query(f"WITH {_NUMBERED} SELECT src, dst, weight, eid FROM ne")
def edge_numbers(spark, sf_dir):
    return transition_graph(spark, sf_dir).numbered_edges()


@query(f"WITH {_EDGES} SELECT dst, src, weight, row_number() OVER (ORDER BY dst, src) - 1 AS position FROM e")
def compressed_columns(spark, sf_dir):
    return P.with_index(transition(spark, sf_dir).select("dst", "src", "weight"), "position", "dst", "src")


@query("SELECT c_nationkey AS src, s_nationkey AS dst, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2".replace("c_nationkey AS src, s_nationkey AS dst", "CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst"))
def trade_edges(spark, sf_dir):
    return trade(spark, sf_dir)


_SUPPLY = f"se AS (SELECT o_custkey AS src, l_suppkey + {SUPPLIERS} AS dst, CAST(min(l_quantity) AS BIGINT) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


@query(f"WITH {_SUPPLY} SELECT dst AS vid, count(*) AS in_degree, max(weight) AS widest FROM se GROUP BY dst")
def supply_in_degree(spark, sf_dir):
    e = supply(spark, sf_dir)
    return e.groupBy(F.col("dst").alias("vid")).agg(F.count("*").alias("in_degree"), F.max("weight").alias("widest"))


# --- loading and writing


def _as_text(df: DataFrame, line: str, name: str) -> str:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.selectExpr(f"{line} as value").write.text(path)
    return path


@query(f"WITH {_EDGES} SELECT src, dst, CAST(weight AS DOUBLE) AS weight FROM e")
def load_directed(spark, sf_dir):
    path = _as_text(transition(spark, sf_dir), "concat(src, ' \t', dst, '  ', weight)", "edges-directed")
    return load_edges(spark, path, LoadOptions(directed=True))[0]


@query(f"WITH {_EDGES} SELECT src, dst, 1.0::DOUBLE AS weight FROM (SELECT src, dst FROM e UNION SELECT dst, src FROM e)")
def load_default(spark, sf_dir):
    path = _as_text(transition(spark, sf_dir), "concat(src, ' ', dst)", "edges-default")
    return load_edges(spark, path)[0]


@query(f"WITH {_EDGES} SELECT (SELECT count(*) FROM e) AS rejected")
def load_rejects(spark, sf_dir):
    path = _as_text(transition(spark, sf_dir).selectExpr("explode(array(concat(src, ' ', dst), cast(src as string), '% note', ' ')) as l"), "l", "edges-rejects")
    return spark.createDataFrame([(rejected(spark, path),)], "rejected long")


@query(f"WITH {_EDGES} SELECT src - 1 AS src, dst - 1 AS dst, CAST(weight AS DOUBLE) AS weight FROM e WHERE src <> 0 AND dst <> 0")
def load_base_1(spark, sf_dir):
    path = _as_text(transition(spark, sf_dir), "concat(src, ' ', dst, ' ', weight)", "edges-one-based")
    return load_edges(spark, path, LoadOptions(directed=True, base_1=True))[0]


@query("SELECT * FROM (VALUES ('', true), ('.adj', true), ('.txt', false)) t(ext, accepted)")
def extension_guard(spark, sf_dir):
    path = f"{_as_text(transition(spark, sf_dir), 'concat(src, dst)', 'edges')}.adj"
    return spark.createDataFrame([(ext, not _fails(ValueError, check_extension, path, ext)) for ext in ("", ".adj", ".txt")], "ext string, accepted boolean")


def _fails(kind: type[Exception] | tuple[type[Exception], ...], f: Callable, *args, **options) -> bool:
    try:
        f(*args, **options)
    except kind:
        return True
    return False


@query(f"WITH {_EDGES} SELECT src AS vid, concat(CAST(sum(weight) AS BIGINT), '  ', count(*)) AS rest FROM e GROUP BY src")
def load_raw_vertices(spark, sf_dir):
    rows = transition(spark, sf_dir).groupBy("src").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    path = _as_text(rows, "concat(src, '\t', w, '  ', n)", "raw")
    return load_vertices(spark, path, lambda rest: {"rest": rest}, raw=True)


_SEEN = f"{_STEPS}, ends AS (SELECT src AS id, ts, event_id, 0 AS s FROM st WHERE src <> dst UNION ALL SELECT dst, ts, event_id, 1 FROM st WHERE src <> dst), f AS (SELECT id, min((ts, event_id, s)) AS seen FROM ends GROUP BY id)"


@query(f"WITH {_SEEN} SELECT id AS orig_id, vid FROM (SELECT id, row_number() OVER (ORDER BY seen) - 1 AS vid FROM f) WHERE id % 40 = 7 UNION ALL SELECT -5, NULL")
def id_lookup(spark, sf_dir):
    steps = event_steps(spark, sf_dir).where("src <> dst")
    ids = written(encounter_ids(steps), "ids")
    g = Graph(renamed(steps.select("src", "dst", "weight"), ids), ids.select("vid"), ids=ids)
    wanted = ids.where("orig_id % 40 = 7").select("orig_id").unionByName(spark.range(1).select(F.lit(-5).cast("long").alias("orig_id")))
    return g.lookup(wanted)


@query(f"WITH {_STEPS}, both_ AS (SELECT src, dst, weight, (ts, event_id, 0) AS place FROM st WHERE src <> dst UNION ALL SELECT dst, src, weight, (ts, event_id, 1) FROM st WHERE src <> dst) SELECT src, dst, arg_min(weight, place) AS weight FROM both_ GROUP BY src, dst")
def graph_from_edges(spark, sf_dir):
    return Graph.from_edges(event_steps(spark, sf_dir), directed=False, keep_self_loops=False, keep_duplicates=False).edges


@query("SELECT * FROM (VALUES ('CSR|NORMAL', true, true, 'CSR'), ('CSR|TRANSPOSE', false, true, 'CSR'), ('COO', false, false, 'COO'), ('CSR|NORMAL|TRANSPOSE', true, true, 'CSR')) t(views, expands, has_either, layout)")
def view_algebra(spark, sf_dir):
    rows = [(n, v.has_all(ADVANCE_VIEWS), v.has_some(Views.NORMAL | Views.TRANSPOSE), v.first().name) for n, v in (("CSR|NORMAL", ADVANCE_VIEWS), ("CSR|TRANSPOSE", BLAS_VIEWS), ("COO", Views.COO), ("CSR|NORMAL|TRANSPOSE", ALL_VIEWS))]
    return spark.createDataFrame(rows, "views string, expands boolean, has_either boolean, layout string")


@query(f"WITH {_EDGES}, r AS (SELECT * FROM (VALUES ('normal only', true, false), ('transpose only', false, true), ('both', true, true)) t(views, out_ok, in_ok)) SELECT views, CASE WHEN out_ok THEN (SELECT count(*) FROM e) END AS by_source, CASE WHEN in_ok THEN (SELECT count(*) FROM e) END AS by_target FROM r")
def declared_views(spark, sf_dir):
    e, rows = transition(spark, sf_dir), []
    for name, views in (("normal only", ADVANCE_VIEWS), ("transpose only", BLAS_VIEWS), ("both", ALL_VIEWS)):
        g = Graph(e, views=views)
        rows.append((name, *(None if _fails(ValueError, f) else f().count() for f in (g.by_source, g.by_target))))
    return spark.createDataFrame(rows, "views string, by_source long, by_target long")


_PAPERS = "p AS (SELECT vec_id, label, list_sum([CASE WHEN v > 0 THEN 1 ELSE 0 END FOR v IN embedding]) AS n FROM embeddings)"


def _citations(spark, sf_dir):
    """A citation set of the embeddings and the transitions, as text, in the order of the ids."""
    words = "array_join(transform(features, v -> if(v > 0, '1', '0')), ' ')"
    content = _as_text(features(spark, sf_dir).coalesce(1).sortWithinPartitions("vid"), f"concat('p', vid, '\t', {words}, '\t', 'class', label)", "content")
    cites = _as_text(transition(spark, sf_dir), "concat('p', dst * 3, '\t', 'p', src * 3)", "cites")
    return load_citations(spark, content, cites)


@query(f"WITH {_PAPERS}, c AS (SELECT label, row_number() OVER (ORDER BY min(vec_id)) - 1 AS place FROM p GROUP BY label) SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vid, CAST(place AS INTEGER) AS label, CAST(n AS BIGINT) AS n_words FROM p JOIN c USING (label)")
def load_citation_features(spark, sf_dir):
    x, _, _ = _citations(spark, sf_dir)
    return x.select("vid", "label", F.aggregate("features", F.lit(0.0), lambda a, v: a + v).cast("long").alias("n_words"))


@query(f"WITH {_EDGES}, i AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS vid FROM embeddings) SELECT a.vid AS src, b.vid AS dst, 1.0::DOUBLE AS weight FROM e JOIN i a ON a.vec_id = src * 3 JOIN i b ON b.vec_id = dst * 3")
def load_citation_edges(spark, sf_dir):
    return _citations(spark, sf_dir)[1]


def _onnx(parameters: dict[str, np.ndarray]) -> bytes:
    """A model that has nothing but these parameters, in the wire format."""

    def field(number: int, data: bytes) -> bytes:
        return bytes([number << 3 | 2]) + _varint(len(data)) + data

    def _varint(n: int) -> bytes:
        return bytes([n & 127 | 128]) + _varint(n >> 7) if n > 127 else bytes([n])

    tensors = [b"".join(b"\x08" + _varint(d) for d in a.shape) + b"\x10\x01" + field(8, name.encode()) + field(9, a.astype("<f4").tobytes()) for name, a in parameters.items()]
    return field(7, b"".join(field(5, t) for t in tensors))


@query("SELECT 'gc.weight' AS name, i AS row, j AS col, CAST(((i * 7 + j * 3) % 11 - 5) / 10.0 AS FLOAT)::DOUBLE AS val FROM range(64) a(i), range(8) b(j) UNION ALL SELECT 'gc.bias', 0, j, CAST(((j * 3 + 4) % 11 - 5) / 10.0 AS FLOAT)::DOUBLE FROM range(8) b(j)")
def load_onnx(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:  # read again at once, by the driver
        Path(folder, "model.onnx").write_bytes(_onnx({"gc.weight": np.array(_weights(64, 8, 0)), "gc.bias": np.array(_weights(1, 8, 4)[0])}))
        found = load_initializers(f"{folder}/model.onnx")
    return spark.createDataFrame([(n, i, j, float(v)) for n, a in found.items() for (i, j), v in np.ndenumerate(a)], "name string, row long, col long, val double")


@query(f"WITH {_X} SELECT vid, round(sum(val), 4) AS total, max(k) + 1 AS width FROM (SELECT vid, k, CAST(round(val * 1000) AS BIGINT) / 1000.0::DOUBLE AS val FROM x) GROUP BY vid")
def load_features(spark, sf_dir):
    line = "concat(vid, ' ', array_join(transform(features, x -> cast(cast(round(x * 1000) as bigint) / 1000.0 as string)), '\t'))"
    path = _as_text(features(spark, sf_dir), line, "features")
    found = load_vertices(spark, path, lambda t: {"features": numbers()(t)})
    return found.select("vid", F.round(F.aggregate("features", F.lit(0.0), lambda s, v: s + v), 4).alias("total"), F.size("features").cast("long").alias("width"))


@query(f"WITH {_VERTICES}, w AS (SELECT src, CAST(sum(weight) AS BIGINT) AS s FROM e WHERE src % 3 = 0 GROUP BY src) SELECT vid, CAST(coalesce(s, 0) AS DOUBLE) AS val FROM v LEFT JOIN w ON w.src = v.vid")
def load_vertex_vector(spark, sf_dir):
    g = transition_graph(spark, sf_dir)
    path = _as_text(g.out_weight().where("vid % 3 = 0"), "concat(vid, ' ', out_weight)", "vector")
    return load_vector(spark, path, g.size()["num_vertices"])


@query(f"WITH {_EDGES} SELECT printf('%d-%.6f', src, CAST(sum(weight) AS DOUBLE)) AS value FROM e GROUP BY src")
def text_sink(spark, sf_dir):
    return text_lines(transition_graph(spark, sf_dir).out_weight(), "vid", "out_weight")


# --- traversal


@query(f"WITH {_EDGES} SELECT src, dst, weight FROM e WHERE src < 10 AND weight > 500")
def advance_one(spark, sf_dir):
    g = transition_graph(spark, sf_dir)
    return advance(g.edges, g.vertices.where("vid < 10"), F.col("weight") > 500).select("src", "dst", "weight")


@query(f"WITH {_EDGES} SELECT dst AS vid, min(weight) AS nearest FROM e WHERE src IN (1, 2, 3) GROUP BY dst HAVING dst NOT IN (1, 2, 3)")
def filter_visited(spark, sf_dir):
    g = transition_graph(spark, sf_dir)
    return _stepped(g).where("active").select("vid", "nearest")


def _stepped(g: Graph) -> DataFrame:
    """One expansion of three vertices, which drops what was seen before."""
    seen = F.col("vid").isin(1, 2, 3)
    program = AdvanceProgram(message=lambda: F.col("weight"), reduce=F.min, update=lambda: {"nearest": F.col("message")}, activate=lambda: F.lit(True), drop=lambda: seen)
    return advance_step(g.edges, g.vertices.select("vid", F.lit(None).cast("long").alias("nearest"), seen.alias("active")), program)


@query(f"WITH {_VERTICES}, m AS (SELECT dst, min(weight) AS nearest FROM e WHERE src IN (1, 2, 3) GROUP BY dst) SELECT vid, nearest, nearest IS NOT NULL AND vid NOT IN (1, 2, 3) AS active FROM v LEFT JOIN m ON dst = vid")
def advance_filter(spark, sf_dir):
    return _stepped(transition_graph(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT count(DISTINCT dst) AS n_active FROM e WHERE src IN (1, 2, 3) AND dst NOT IN (1, 2, 3)")
def activated_count(spark, sf_dir):
    return activated(_stepped(transition_graph(spark, sf_dir)))


@query(f"WITH {_EDGES} SELECT count(*) AS size FROM e WHERE src < 20")
def frontier_size(spark, sf_dir):
    g = transition_graph(spark, sf_dir)
    return frontier_degree_sum(g, g.vertices.where("vid < 20"))


@query(f"WITH {_VERTICES} SELECT v.vid, label, CAST(len(embedding) AS BIGINT) AS width FROM v LEFT JOIN embeddings ON vec_id = v.vid")
def vertex_properties(spark, sf_dir):
    g = transition_graph(spark, sf_dir).with_properties(features(spark, sf_dir), strict=False)
    return g.vertices.select("vid", "label", F.when(F.col("features").isNotNull(), F.size("features")).cast("long").alias("width"))


# --- products


def _values(spark, sf_dir):
    return transition_graph(spark, sf_dir).vertices.select("vid", (F.col("vid") % 7 + 1).alias("val"))


def _spmv(name: str, semiring: S.Semiring, sql: str, every: bool):
    def f(spark, sf_dir):
        g = transition_graph(spark, sf_dir)
        return L.spmv(g.edges, _values(spark, sf_dir), semiring, vertices=g.vertices if every else None)

    f.__name__ = name
    query(sql)(f)


_MET = f"WITH {_VERTICES}, m AS (SELECT dst, weight, src % 7 + 1 AS x FROM e)"
_spmv("spmv_plus_times", S.PLUS_TIMES, f"{_MET} SELECT vid, CAST(coalesce(sum(weight * x), 0) AS BIGINT) AS val FROM v LEFT JOIN m ON m.dst = v.vid GROUP BY vid", True)
_spmv("spmv_min_plus", S.MIN_PLUS, f"{_MET} SELECT dst AS vid, min(weight + x) AS val FROM m GROUP BY dst", False)
_spmv("spmv_min_sum", S.MIN_PLUS_SUM, f"{_MET} SELECT vid, CAST(coalesce(sum(least(weight, x)), 0) AS BIGINT) AS val FROM v LEFT JOIN m ON m.dst = v.vid GROUP BY vid", True)
_spmv("spmv_max_min", S.MAX_MIN, f"{_MET} SELECT dst AS vid, max(least(weight, x)) AS val FROM m GROUP BY dst", False)
_spmv("spmv_max_times", S.MAX_TIMES, f"{_MET} SELECT vid, max(weight * x) AS val FROM v LEFT JOIN m ON m.dst = v.vid GROUP BY vid", True)
_spmv("spmv_folded", S.Semiring("xor", 0, lambda w, x: w + x, S.folded(0, lambda a, b: a.bitwiseXOR(b), "long")), f"{_MET} SELECT dst AS vid, bit_xor(weight + x) AS val FROM m GROUP BY dst", False)


@query(f"WITH {_EDGES} SELECT dst AS vid, bool_or(src % 5 = 0) AS val FROM e GROUP BY dst")
def spmv_or_and(spark, sf_dir):
    g = transition_graph(spark, sf_dir)
    return L.spmv(g.edges, g.vertices.select("vid", (F.col("vid") % 5 == 0).alias("val")), S.OR_AND)


def _long(spark, sf_dir):
    return features(spark, sf_dir).select(F.col("vid").alias("row"), F.posexplode("features").alias("col", "val")).withColumn("col", F.col("col").cast("long"))


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Sums of doubles, rounded so that the order of addition doesn't show; no negative zero."""
    return df.withColumn("val", F.round("val", places) + F.lit(0.0))


@query(f"WITH {_EDGES}, {_X} SELECT dst AS row, k AS col, round(sum(weight * val), 6) + 0.0 AS val FROM e JOIN x ON x.vid = e.src WHERE k < 8 GROUP BY 1, 2")
def spmm_long(spark, sf_dir):
    return _rounded(L.spmm(transition(spark, sf_dir), _long(spark, sf_dir).where("col < 8")))


@query(f"WITH {_EDGES}, {_X} SELECT dst AS row, k AS col, round(sum(weight * val), 6) + 0.0 AS val FROM e JOIN x ON x.vid = e.src GROUP BY 1, 2")
def spmm_arrays(spark, sf_dir):
    out = L.spmm_arrays(transition(spark, sf_dir), features(spark, sf_dir), 64)
    return _rounded(out.select(F.col("vid").alias("row"), F.posexplode("features").alias("col", "val")).withColumn("col", F.col("col").cast("long")))


_GEMM = f"WITH {_X}, a AS (SELECT vid AS i, k, val FROM x WHERE vid < 64), b AS (SELECT vid AS k, k AS j, val FROM x WHERE vid < 64 AND k < 16) SELECT i AS row, j AS col, round(sum(a.val * b.val), 6) + 0.0 AS val FROM a JOIN b USING (k) GROUP BY 1, 2"


@query(_GEMM)
def gemm_long(spark, sf_dir):
    x = _long(spark, sf_dir).where("row < 64")
    return _rounded(L.gemm(x, x.where("col < 16")))


@query(_GEMM)
def gemm_col_major(spark, sf_dir):
    x = _long(spark, sf_dir).where("row < 64")
    swapped = x.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")
    return _rounded(L.gemm(swapped, swapped.where("row < 16"), a_col_major=True, b_col_major=True))


@query(f"WITH {_EDGES}, {_X} SELECT src, dst, round(any_value(weight) * sum(l.val * r.val), 6) + 0.0 AS val FROM e JOIN x l ON l.vid = e.src JOIN x r ON r.vid = e.dst AND r.k = l.k GROUP BY 1, 2")
def sddmm(spark, sf_dir):
    x = features(spark, sf_dir)
    return _rounded(L.sddmm(transition(spark, sf_dir), x, x))


@query(f"WITH {_EDGES} SELECT src, dst, round(weight / greatest(sum(weight) OVER (PARTITION BY src), 1e-10), 9) AS weight FROM e")
def row_normalise(spark, sf_dir):
    return L.row_normalised(transition(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


@query(f"WITH {_VERTICES} SELECT src, dst, CAST(sum(w) AS DOUBLE) AS weight FROM (SELECT src, dst, weight AS w FROM e UNION ALL SELECT dst, src, weight FROM e UNION ALL SELECT vid, vid, 1 FROM v) GROUP BY 1, 2")
def symmetrise(spark, sf_dir):
    g = transition_graph(spark, sf_dir)
    return L.symmetrised(g.edges, g.vertices)


# --- primitives


@query("SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY ts, event_id) AS BIGINT) AS total FROM events")
def scan_sum(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return P.inclusive_scan(e, "cents", "total", "ts", "event_id").select("event_id", "total")


@query("SELECT event_id, max(user_id) OVER (ORDER BY ts, event_id) AS highest FROM events")
def scan_max(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return P.inclusive_scan(e, "user_id", "highest", "ts", "event_id", reduce=F.max, combine=lambda a, b: F.greatest(a, b)).select("event_id", "highest")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey < c_custkey) AS position FROM customer")
def lower_bound(spark, sf_dir):
    return P.lower_bound(table(spark, sf_dir, "orders").select("o_custkey"), table(spark, sf_dir, "customer").select("c_custkey"), "o_custkey", "c_custkey")


@query(f"WITH {_VERTICES}, w AS (SELECT src, count(*) AS n FROM e GROUP BY src) SELECT vid, coalesce(CASE WHEN n > 20 THEN n END, -1) AS n FROM v LEFT JOIN w ON w.src = v.vid")
def scatter(spark, sf_dir):
    g = transition_graph(spark, sf_dir)
    return P.scatter(g.vertices, g.edges.groupBy(F.col("src").alias("vid")).agg(F.count("*").alias("n")), "vid", "n", -1, F.col("n") > 20)


@query(f"WITH {_VERTICES} SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS place FROM v WHERE vid % 3 = 1")
def compact(spark, sf_dir):
    return P.with_index(P.copy_if(transition_graph(spark, sf_dir).vertices, F.col("vid") % 3 == 1), "place", "vid")


@query(f"WITH {_VERTICES}, o AS (SELECT src AS vid, count(*) AS n FROM e GROUP BY 1), i AS (SELECT dst AS vid, count(*) AS n FROM e GROUP BY 1) SELECT max(abs(coalesce(o.n, 0) - coalesce(i.n, 0))) AS max_diff FROM v LEFT JOIN o USING (vid) LEFT JOIN i USING (vid)")
def max_diff(spark, sf_dir):
    g = transition_graph(spark, sf_dir)
    return P.max_difference(g.out_degree().withColumnRenamed("out_degree", "n"), g.in_degree().withColumnRenamed("in_degree", "n"), "vid", "n")


@query(f"WITH {_EDGES} SELECT CAST(sum(weight * weight) AS BIGINT) AS result FROM e")
def transform_reduce(spark, sf_dir):
    return P.transform_reduce(transition(spark, sf_dir), F.col("weight") * F.col("weight"), F.sum)


@query(f"WITH {_VERTICES}, w AS (SELECT src, count(*) AS n FROM e GROUP BY src) SELECT vid, coalesce(n, 0) AS n, 7 AS seven, row_number() OVER (ORDER BY coalesce(n, 0), vid) - 1 AS place FROM v LEFT JOIN w ON src = vid")
def sort_by_key(spark, sf_dir):
    degrees = P.fill(transition_graph(spark, sf_dir).out_degree().withColumnRenamed("out_degree", "n"), "seven", 7)
    ordered = P.sort_by_key(degrees, "n", "vid")
    return P.with_index(ordered, "place", "n", "vid")


# --- algorithms



def _kept(spark, sf_dir) -> Graph:
    """Edges that many passes read, written once."""
    return Graph(written(transition(spark, sf_dir), "edges"))


_ROUNDS = 60
_SSSP = f"""WITH RECURSIVE {_VERTICES}, l AS (SELECT src, dst, weight FROM e UNION ALL SELECT vid, vid, 0 FROM v),
d(vid, dist, it) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0 UNION ALL SELECT l.dst, CAST(min(d.dist + l.weight) AS BIGINT), d.it + 1 FROM d JOIN l ON l.src = d.vid WHERE d.it < {_ROUNDS} GROUP BY l.dst, d.it)
SELECT v.vid, d.dist FROM v LEFT JOIN d ON d.vid = v.vid AND d.it = {_ROUNDS}"""
for _f in (sssp_advance, sssp_blas_sparse, sssp_blas_dense):

    def _paths(spark, sf_dir, f=_f):
        return f(_kept(spark, sf_dir), 0)

    _paths.__name__ = _f.__name__
    query(_SSSP)(_paths)

#: Odd ids are in no edge, and some vertices are never reached or lead nowhere.
_GAPS = f"{_STEPS}, e AS (SELECT src * 2 AS src, dst * 2 AS dst, min(weight) AS weight FROM st WHERE src <> dst AND dst % 4 <> 1 AND src % 5 <> 2 GROUP BY 1, 2), v AS (SELECT unnest(range((SELECT max(greatest(src, dst)) + 1 FROM e))) AS vid)"


def _gaps(spark, sf_dir):
    e = transition(spark, sf_dir).where("dst % 4 <> 1 and src % 5 <> 2")
    return Graph(written(e.select((F.col("src") * 2).alias("src"), (F.col("dst") * 2).alias("dst"), "weight"), "edges"))


@query(_SSSP.replace(_VERTICES, _GAPS))
def sssp_gaps(spark, sf_dir):
    return sssp_advance(_gaps(spark, sf_dir), 0)


@query(f"""WITH RECURSIVE l AS (SELECT i AS src, i + 1 AS dst FROM range(40) r(i)), d(vid, dist) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT l.dst, d.dist + l.dst % 3 + 1 FROM d JOIN l ON l.src = d.vid) SELECT vid, dist FROM d""")
def sssp_long_path(spark, sf_dir):
    """A path of forty edges: as many rounds, with one active vertex each."""
    e = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), ((F.col("id") + 1) % 3 + 1).alias("weight"))
    return sssp_advance(Graph(e), 0)


_PASSES = 10


def _pagerank_sql(passes: int) -> str:
    return f"""WITH RECURSIVE {_VERTICES}, s AS (SELECT src, sum(weight) AS total FROM e GROUP BY src), n AS (SELECT count(*) AS n FROM v),
l AS (SELECT e.src, e.dst, 0.85::DOUBLE * weight / total AS p FROM e JOIN s ON s.src = e.src UNION ALL SELECT vid, vid, 0.0::DOUBLE FROM v),
r(vid, rank, it) AS (SELECT vid, 1.0::DOUBLE / n, 0 FROM v, n UNION ALL SELECT l.dst, 0.15::DOUBLE / any_value(n.n) + sum(r.rank * l.p), r.it + 1 FROM r JOIN l ON l.src = r.vid, n WHERE r.it < {passes} GROUP BY l.dst, r.it)
SELECT vid, round(rank, 9) AS rank FROM r WHERE it = {passes}"""


@query(_pagerank_sql(_PASSES))
def pagerank_fixed(spark, sf_dir):
    return pagerank(_kept(spark, sf_dir), iterations=_PASSES).withColumn("rank", F.round("rank", 9))


@query(_pagerank_sql(_PASSES - 1))
def pagerank_previous(spark, sf_dir):
    return pagerank(_kept(spark, sf_dir), iterations=_PASSES, result="previous").withColumn("rank", F.round("rank", 9))


@query(_pagerank_sql(60))
def pagerank_converged(spark, sf_dir):
    """Converged so far that nine places agree with those of sixty passes."""
    return pagerank(_kept(spark, sf_dir), eps=1e-13).withColumn("rank", F.round("rank", 9))


@query(_pagerank_sql(_PASSES).replace(_VERTICES, _GAPS))
def pagerank_gaps(spark, sf_dir):
    return pagerank(_gaps(spark, sf_dir), iterations=_PASSES).withColumn("rank", F.round("rank", 9))


# --- graph convolution


def _weights(rows: int, cols: int, salt: int) -> list[list[float]]:
    return [[((i * 7 + j * 3 + salt) % 11 - 5) / 10 for j in range(cols)] for i in range(rows)]


def _w(name: str, rows: int, cols: int, salt: int) -> str:
    return f"{name} AS (SELECT i AS k, j, ((i * 7 + j * 3 + {salt}) % 11 - 5) / 10.0::DOUBLE AS w FROM range({rows}) a(i), range({cols}) b(j))"


def _unpacked(df: DataFrame) -> DataFrame:
    return _rounded(df.select("vid", F.posexplode("features").alias("col", "val")).withColumn("col", F.col("col").cast("long")))


@query(f"""WITH {_EDGES}, {_X}, {_w('w', 64, 8, 0)}, xw AS (SELECT vid, j, sum(val * w) AS val FROM x JOIN w USING (k) GROUP BY 1, 2),
g AS (SELECT dst AS vid, j, sum(weight * val) AS val FROM e JOIN xw ON xw.vid = e.src GROUP BY 1, 2),
a AS (SELECT vec_id AS vid, j FROM embeddings, range(8) t(j)) SELECT a.vid, a.j AS col, round(coalesce(g.val, 0), 6) + 0.0 AS val FROM a LEFT JOIN g USING (vid, j)""")
def gcn_layer(spark, sf_dir):
    layer = GraphConvolution(64, 8)
    layer.load_state_dict({"weight": np.array(_weights(64, 8, 0))})
    return _unpacked(layer.forward(transition(spark, sf_dir), features(spark, sf_dir)))


@query(f"""WITH {_EDGES}, {_X}, {_w('w1', 64, 16, 1)}, {_w('w2', 16, 4, 2)},
s AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, 1.0::DOUBLE AS w FROM e UNION ALL SELECT dst, src, 1.0::DOUBLE FROM e UNION ALL SELECT vec_id, vec_id, 1.0::DOUBLE FROM embeddings) GROUP BY 1, 2),
a AS (SELECT src AS r, dst AS c, w / greatest(sum(w) OVER (PARTITION BY src), 1e-10) AS w FROM s),
xw AS (SELECT vid, j, sum(val * w) AS val FROM x JOIN w1 USING (k) GROUP BY 1, 2),
h AS (SELECT r AS vid, j AS k, greatest(sum(a.w * val), 0) AS val FROM a JOIN xw ON xw.vid = a.c GROUP BY 1, 2),
hw AS (SELECT vid, j, sum(val * w) AS val FROM h JOIN w2 USING (k) GROUP BY 1, 2),
o AS (SELECT r AS vid, j, sum(a.w * val) + (j - 1) / 10.0::DOUBLE AS val FROM a JOIN hw ON hw.vid = a.c GROUP BY 1, 2),
m AS (SELECT vid, max(val) AS m FROM o GROUP BY vid), z AS (SELECT vid, ln(sum(exp(val - m))) AS z FROM o JOIN m USING (vid) GROUP BY vid)
SELECT vid, j AS col, round(val - m - z, 6) + 0.0 AS val FROM o JOIN m USING (vid) JOIN z USING (vid)""")
def gcn_forward(spark, sf_dir):
    model = full_gcn(64, 16, 4)
    model.load_state_dict({"gc1.weight": np.array(_weights(64, 16, 1)), "gc2.weight": np.array(_weights(16, 4, 2)), "gc2.bias": np.array([[-0.1, 0.0, 0.1, 0.2]])})
    x = features(spark, sf_dir)
    edges = transition(spark, sf_dir).withColumn("weight", F.lit(1.0))
    return _unpacked(model.forward(propagation(edges, x), x))


@query(f"""WITH {_EDGES}, {_X}, {_w('w1', 64, 16, 1)}, {_w('w2', 16, 4, 2)},
xw AS (SELECT vid, j, sum(val * w) AS val FROM x JOIN w1 USING (k) GROUP BY 1, 2), every AS (SELECT vec_id AS vid, j FROM embeddings, range(16) t(j)),
h AS (SELECT every.vid, every.j AS k, coalesce(g.val, 0) AS val FROM every LEFT JOIN (SELECT dst AS vid, j, sum(val) AS val FROM e JOIN xw ON xw.vid = e.src GROUP BY 1, 2) g USING (vid, j)),
hw AS (SELECT vid, j, sum(val * w) AS val FROM h JOIN w2 USING (k) GROUP BY 1, 2),
o AS (SELECT dst AS vid, j, sum(val) AS val FROM e JOIN hw ON hw.vid = e.src GROUP BY 1, 2)
SELECT a.vid, a.j AS col, round(coalesce(o.val, 0), 6) + 0.0 AS val FROM (SELECT vid, j FROM every WHERE j < 4) a LEFT JOIN o USING (vid, j)""")
def gcn_plain(spark, sf_dir):
    model = build_module(GCN, {"nfeat": 64, "nhid": 16, "nclass": 4, "drop": 0.5})
    model.load_state_dict({"gc1.weight": np.array(_weights(64, 16, 1)), "gc2.weight": np.array(_weights(16, 4, 2))})
    return _unpacked(module_forward(model, transition(spark, sf_dir).withColumn("weight", F.lit(1.0)), features(spark, sf_dir)))


@query(f"""WITH {_EDGES}, {_X}, y AS (SELECT vid, k, val * 2 AS val FROM x WHERE k < 8),
d AS (SELECT src, dst, any_value(weight) / 100.0::DOUBLE * sum(l.val * r.val) AS w FROM e JOIN y l ON l.vid = src JOIN y r ON r.vid = dst AND r.k = l.k GROUP BY 1, 2),
g AS (SELECT dst AS vid, k, sum(w * val) AS val FROM d JOIN y ON y.vid = d.src GROUP BY 1, 2)
SELECT y.vid, y.k AS col, round(y.val + 0.1::DOUBLE * coalesce(g.val, 0), 6) + 0.0 AS val FROM y LEFT JOIN g USING (vid, k)""")
def gnn_program(spark, sf_dir):
    """Edges weighed by the likeness of their ends."""
    program = GnnProgram(construct=lambda x: F.transform(F.slice(x, 1, 8), lambda v: v * 2), apply=lambda own, got: F.zip_with(own, got, lambda a, b: a + b * 0.1), width=8, weigh=True)
    return _unpacked(engine_forward([program], transition(spark, sf_dir).withColumn("weight", F.col("weight") / 100.0), features(spark, sf_dir)))


@query("SELECT * FROM (VALUES ('', false), ('a.b', false), ('gc1', false), ('none', true), ('scale', true)) t(name, accepted)")
def module_names(spark, sf_dir):
    model = GCN(4, 3, 2)
    model.register_parameter("none", None)
    rows = [(n, not _fails(ValueError, model.register_parameter, n, np.ones((1, 1)))) for n in ("", "a.b", "gc1", "scale")]
    return spark.createDataFrame([*rows, ("none", "none" not in dict(model.named_parameters()) and model.parameter("none") is None)], "name string, accepted boolean")


@query("SELECT * FROM (VALUES ('dict', 'gc1.weight', 64, 16), ('dict', 'gc2.weight', 16, 4), ('file', 'gc1.weight', 64, 16), ('file', 'gc2.weight', 16, 4), ('tuple', 'gc1.weight', 64, 16), ('tuple', 'gc2.weight', 16, 4), ('lacking', 'KeyError', 0, 0)) t(source, name, n_rows, n_cols)")
def module_parameters(spark, sf_dir):
    config = {"nfeat": 64, "nhid": 16, "nclass": 4, "drop": 0.5}
    with tempfile.TemporaryDirectory() as folder:  # read again at once, by the driver
        Path(folder, "gcn.json").write_text(json.dumps(config))
        models = {"dict": build_module(GCN, config), "file": build_module(GCN, f"{folder}/gcn.json"), "tuple": build_module(GCN, (64, 16, 4))}
    rows = [(source, n, *a.shape) for source, m in models.items() for n, a in m.named_parameters()]
    if _fails(KeyError, build_module, GCN, {"nfeat": 64}):
        rows.append(("lacking", "KeyError", 0, 0))
    return spark.createDataFrame(rows, "source string, name string, n_rows int, n_cols int")


@query("SELECT * FROM (VALUES ('missing', 'gc2.weight'), ('unexpected', 'other'), ('strict', 'KeyError'), ('shape', 'ValueError')) t(what, name)")
def load_state(spark, sf_dir):
    state = {"gc1.weight": np.ones((64, 16)), "other": np.ones((1, 1))}
    missing, unexpected = GCN(64, 16, 4).load_state_dict(state, strict=False)
    rows = [("missing", n) for n in missing] + [("unexpected", n) for n in unexpected]
    rows += [("strict", "KeyError")] if _fails(KeyError, GCN(64, 16, 4).load_state_dict, state) else []
    rows += [("shape", "ValueError")] if _fails(ValueError, GCN(64, 16, 4).load_state_dict, {"gc1.weight": np.ones((2, 2))}, strict=False) else []
    return spark.createDataFrame(rows, "what string, name string")


@query(f"WITH {_VERTICES} SELECT 'one for each' AS rows, true AS accepted UNION ALL SELECT 'some lacking', count(vec_id) = count(*) FROM v LEFT JOIN embeddings ON vec_id = vid AND vec_id > 5")
def property_rows(spark, sf_dir):
    g = transition_graph(spark, sf_dir)
    own = g.vertices.select("vid", F.lit(1).alias("one"))
    rows = [("one for each", not _fails(ValueError, g.with_properties, own)), ("some lacking", not _fails(ValueError, g.with_properties, features(spark, sf_dir).where("vid > 5")))]
    return spark.createDataFrame(rows, "rows string, accepted boolean")


@query("WITH c AS (SELECT max(label) + 1 AS n FROM embeddings) SELECT vec_id AS vid, k AS col, CASE WHEN k = label THEN 1.0::DOUBLE ELSE 0.0 END AS val FROM embeddings, (SELECT unnest(range(n)) AS k FROM c)")
def one_hot(spark, sf_dir):
    x = features(spark, sf_dir)
    classes = x.agg(F.max("label")).first()[0] + 1
    return _unpacked(x.select("vid", tensor.one_hot(F.col("label"), int(classes)).alias("features")))


@query(f"WITH {_X} SELECT vid, CAST(min(k) AS INTEGER) AS place FROM (SELECT *, max(val) OVER (PARTITION BY vid) AS m FROM x) WHERE val = m GROUP BY vid")
def argmax(spark, sf_dir):
    return features(spark, sf_dir).select("vid", tensor.argmax(F.col("features")).alias("place"))


def _columns(f):
    return lambda spark, sf_dir: _unpacked(features(spark, sf_dir).select("vid", f(F.col("features")).alias("features")))


for _name, _g, _sql in (
    ("relu", tensor.relu, f"WITH {_X} SELECT vid, k AS col, round(greatest(val, 0.0), 6) + 0.0 AS val FROM x"),
    ("log_softmax", tensor.log_softmax, f"WITH {_X} SELECT vid, k AS col, round(val - max(val) OVER w - ln(sum(exp(val)) OVER w / exp(max(val) OVER w)), 6) + 0.0 AS val FROM x WINDOW w AS (PARTITION BY vid)"),
    ("l2_normalise", tensor.l2_normalised, f"WITH {_X} SELECT vid, k AS col, round(val / greatest(sqrt(sum(val * val) OVER (PARTITION BY vid)), 1e-12), 6) + 0.0 AS val FROM x"),
):
    _fn = _columns(_g)
    _fn.__name__ = _name
    query(_sql)(_fn)


@query(f"WITH {_X}, b AS (SELECT vid, min(k) AS k FROM (SELECT *, max(val) OVER (PARTITION BY vid) AS m FROM x) WHERE val = m GROUP BY vid) SELECT round(avg(CASE WHEN b.k = label THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM b JOIN embeddings ON vec_id = vid")
def accuracy(spark, sf_dir):
    return tensor.accuracy(features(spark, sf_dir), "features").select(F.round("accuracy", 9).alias("accuracy"))


@query("SELECT split, count(*) AS n FROM (SELECT CASE WHEN vec_id < 140 THEN 'train' WHEN vec_id BETWEEN 200 AND 499 THEN 'val' WHEN vec_id BETWEEN 500 AND 1499 THEN 'test' END AS split FROM embeddings) GROUP BY split")
def splits(spark, sf_dir):
    return tensor.splits(features(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("n"))
