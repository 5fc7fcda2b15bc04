from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.functions import tensor as T
from meshwright.gnn.gcn import GCN, GraphConvolution, full_gcn, propagation
from meshwright.gnn.module import Module, build_module
from meshwright.graph import Graph
from meshwright.sources import loader, sinks
from meshwright.sources.options import LoadOptions, VertexOptions, argument_parser, from_arguments


@pytest.fixture
def edges(spark, tmp_path):
    def load(text, name="g.adj", **options):
        (tmp_path / name).write_bytes(text.encode())
        df, ids = loader.load_edges(spark, str(tmp_path / name), LoadOptions(**options))
        return [tuple(r) for r in df.orderBy("src", "dst", "weight").collect()], ids

    return load


def test_edge_cases(edges, spark, tmp_path):
    d = {"directed": True}
    assert edges("0 1\n", **d)[0] == [(0, 1, 1.0)]
    assert edges("a b 4\nb a 9\n".replace("a", "1").replace("b", "2"))[0] == [(1, 2, 4.0), (2, 1, 4.0)]
    assert edges("0 5\n", **d)[0] == [(0, 5, 1.0)]
    assert Graph.load(spark, str(tmp_path / "g.adj"), LoadOptions(directed=True)).size()["num_vertices"] == 6
    assert edges("  1 \t 2   3.5 \r\n\r\n% note\n   % note\n3 4\r\n", **d)[0] == [(1, 2, 3.5), (3, 4, 1.0)]
    assert edges("", **d)[0] == [] and edges("\n\n", **d)[0] == []
    assert edges("1 2 x\n5\n-1 3\n1 z\n1 3 2\n", **d)[0] == [(1, 3, 2.0)]
    assert loader.rejected(spark, str(tmp_path / "g.adj")) == 4
    assert edges("12x ab 3y\n", lenient=True, **d)[0] == [(12, 0, 3.0)]
    assert edges("# a\n1 2\n", comment="#", **d)[0] == [(1, 2, 1.0)] and edges("1 2\n", comment="", **d)[0] == [(1, 2, 1.0)]
    assert edges("1,;2;7\n", separators=",;", **d)[0] == [(1, 2, 7.0)]
    assert edges("1 2 9\n", weighted=False, **d)[0] == [(1, 2, 1.0)]


def test_options(edges):
    text = "3 3 1\n1 2 5\n1 2 6\n2 1 7\n"
    assert edges(text, directed=True)[0] == [(1, 2, 5.0), (2, 1, 7.0)]
    assert edges(text, directed=True, keep_self_loops=True, keep_duplicates=True)[0] == [(1, 2, 5.0), (1, 2, 6.0), (2, 1, 7.0), (3, 3, 1.0)]
    assert edges(text, keep_self_loops=True, keep_duplicates=True)[0] == [(1, 2, 5.0), (1, 2, 6.0), (1, 2, 7.0), (2, 1, 5.0), (2, 1, 6.0), (2, 1, 7.0), (3, 3, 1.0)]
    assert edges("0 4\n1 2 5\n2 3 6\n", base_1=True, directed=True)[0] == [(0, 1, 5.0), (1, 2, 6.0)]
    with pytest.raises(ValueError):
        edges(text, file_ext=".txt")


def test_reorder(edges):
    got, ids = edges("9 9\n7 5 1\n5 9 2\n", reorder=True, directed=True)
    assert [tuple(r) for r in ids.orderBy("vid").collect()] == [(7, 0), (5, 1), (9, 2)] and got == [(0, 1, 1.0), (1, 2, 2.0)]
    got, ids = edges("9 9\n7 5\n", reorder=True)
    assert ids.count() == 2  # a vertex with a loop alone gets no id
    got, ids = edges("paperA b1\nb1 c/2\n", string_ids=True, directed=True)
    assert [r["orig_id"] for r in ids.orderBy("vid").collect()] == ["paperA", "b1", "c/2"] and got == [(0, 1, 1.0), (1, 2, 1.0)]


def test_many_lines_keep_the_first_weight(edges):
    text = "".join(f"{i % 50} {i % 7 + 60} {i}\n" for i in range(5000))
    got, _ = edges(text, directed=True)
    want = {}
    for i in range(5000):
        want.setdefault((i % 50, i % 7 + 60), float(i))
    assert got == [(*k, v) for k, v in sorted(want.items())]


def test_vertices(spark, tmp_path):
    (tmp_path / "v.feat").write_text("0 1.5 2 a\n  % no\n3 4 5 b\nx 1 2 c\n7 8\n")
    path = str(tmp_path / "v.feat")
    parse = lambda t: {"features": loader.numbers()(F.slice(t, 1, 2)), "label": F.element_at(t, -1)}
    got = loader.load_vertices(spark, path, parse, accept=lambda t: F.size(t) == 3).orderBy("vid").collect()
    assert [tuple(r) for r in got] == [(0, [1.5, 2.0], "a"), (3, [4.0, 5.0], "b")]
    raw = loader.load_vertices(spark, path, lambda r: {"rest": r}, VertexOptions(base_1=True), raw=True).orderBy("vid").collect()
    assert [tuple(r) for r in raw] == [(2, "4 5 b"), (6, "8")]
    ids = spark.createDataFrame([(3, 0), (99, 1)], "orig_id long, vid long")
    assert [tuple(r) for r in loader.load_vertices(spark, path, lambda t: {"n": F.size(t)}, ids=ids).collect()] == [(0, 3)]
    (tmp_path / "v.val").write_text("1 0.5\n3 2\n")
    assert [r["val"] for r in loader.load_vector(spark, str(tmp_path / "v.val"), 5).orderBy("vid").collect()] == [0, 0.5, 0, 2, 0]


def test_citations(spark, tmp_path):
    (tmp_path / "c.content").write_text("p1 1 0 1 AI\np2 0 0 1 DB\nx-3 1 1 1 AI\n")
    (tmp_path / "c.cites").write_text("p1 p2\np2 p1\np1 p2\nnone p1\nx-3 p1\n")
    features, e, ids = loader.load_citations(spark, str(tmp_path / "c.content"), str(tmp_path / "c.cites"))
    assert [tuple(r) for r in features.orderBy("vid").collect()] == [(0, [1, 0, 1], 0), (1, [0, 0, 1], 1), (2, [1, 1, 1], 0)]
    assert [tuple(r) for r in e.orderBy("src", "dst").collect()] == [(0, 1, 1.0), (0, 2, 1.0), (1, 0, 2.0)] and ids.count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (0, None)], "vid long, dist double")
    sinks.write_report(df, str(tmp_path / "r.txt"), "vid", "dist", 12.4, missing=9.0)
    assert (tmp_path / "r.txt").read_text() == "Elapsed time: 12 ms\n0-9.000000\n1-2.500000\n"
    sinks.write_text(df, str(tmp_path / "t"), "vid", "dist", missing=0)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["0-0.000000", "1-2.500000"]
    sinks.write_parquet(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_arguments():
    args = argument_parser(src=(int, 0), alpha=(float, 0.85)).parse_args(["-i", "x", "-d", "--keep_dup", "--comment_prefix", "#", "--src", "4"])
    o = from_arguments(args)
    assert o.directed and o.keep_duplicates and o.comment == "#" and not o.reorder and args.src == 4 and args.alpha == 0.85


def test_modules(tmp_path):
    m = Module()
    m.register_parameter("w", np.zeros((2, 3)))
    m.register_parameter("b", None)
    child = m.register_module("c", Module())
    child.register_parameter("w", np.ones((1, 2)))
    assert [n for n, _ in m.named_parameters()] == ["w", "c.w"] and [n for n, _ in m.named_parameters(False)] == ["w"]
    for bad in ("", "a.b", "w", "c"):
        with pytest.raises(ValueError):
            m.register_parameter(bad, None)
    np.savez(tmp_path / "s.npz", **{"w": np.full((2, 3), 2.0), "c.w": np.array([3.0, 4.0])})
    assert m.load_state_dict(loader.load_state_dict(str(tmp_path / "s.npz"))) == ([], [])
    assert child.parameter("w").tolist() == [[3.0, 4.0]]
    assert m.load_state_dict({"w": np.ones((2, 3)), "z": np.ones(1)}, strict=False) == (["c.w"], ["z"])
    with pytest.raises(KeyError):
        m.load_state_dict({"w": np.ones((2, 3))})
    with pytest.raises(ValueError):
        m.load_state_dict({"w": np.ones((3, 2)), "c.w": np.ones((1, 2))})
    np.savez(tmp_path / "bad.npz", a=np.ones((1, 1, 1)))
    with pytest.raises(ValueError):
        loader.load_state_dict(str(tmp_path / "bad.npz"))
    np.savez(tmp_path / "bad.npz", a=np.array(["x"]))
    with pytest.raises(TypeError):
        loader.load_state_dict(str(tmp_path / "bad.npz"))
    config = {"nfeat": 4, "nhid": 3, "nclass": 2, "drop": 0.5}
    (tmp_path / "m.json").write_text(json.dumps(config))
    for c in (config, str(tmp_path / "m.json"), (4, 3, 2, 0.5)):
        assert [(n, p.shape) for n, p in build_module(GCN, c).named_parameters()] == [("gc1.weight", (4, 3)), ("gc2.weight", (3, 2))]
    with pytest.raises(KeyError):
        build_module(GCN, {"nfeat": 4})


def _dense(spark, n=7, f=5, seed=0):
    rng = np.random.default_rng(seed)
    a = (rng.random((n, n)) < 0.4) * rng.integers(1, 4, (n, n)).astype(float)
    x = rng.normal(size=(n, f))
    edges = spark.createDataFrame([(int(c), int(r), float(a[r, c])) for r in range(n) for c in range(n) if a[r, c]], "src long, dst long, weight double")
    features = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "vid long, features array<double>")
    return a, x, edges, features


def _collected(df):
    return np.array([r["features"] for r in df.orderBy("vid").collect()])


@pytest.mark.parametrize("out", [3, 9])
def test_convolution(spark, out):
    a, x, edges, features = _dense(spark)
    layer = GraphConvolution(5, out, bias=True, seed=3)
    assert np.allclose(_collected(layer.forward(edges, features)), a @ (x @ layer.parameter("weight")) + layer.parameter("bias"))


def test_networks(spark):
    a, x, edges, features = _dense(spark)
    plain = GCN(5, 4, 3, seed=1)
    w1, w2 = plain.gc1.parameter("weight"), plain.gc2.parameter("weight")
    assert np.allclose(_collected(plain.forward(edges, features)), a @ (a @ x @ w1) @ w2)
    full = full_gcn(5, 4, 3, seed=1)
    s = a + a.T + np.eye(len(a))
    s /= s.sum(axis=1, keepdims=True)
    # symmetrised weights are by edge, whichever way a weight is stored
    o = s @ (np.maximum(s @ (x @ full.gc1.parameter("weight")), 0) @ full.gc2.parameter("weight")) + full.gc2.parameter("bias")
    o -= o.max(axis=1, keepdims=True)
    want = o - np.log(np.exp(o).sum(axis=1, keepdims=True))
    assert np.allclose(_collected(full.forward(propagation(edges, features), features)), want)


def test_array_functions(spark):
    df = spark.createDataFrame([(1, [-1.0, 2.0, 0.5], 1), (2, [0.0, 0.0, 0.0], 2)], "vid long, x array<double>, label int")
    x = F.col("x")
    got = df.select(T.relu(x).alias("r"), T.log_softmax(x).alias("s"), T.l2_normalised(x).alias("n"), T.argmax(x).alias("a"), T.one_hot(F.col("label"), 3).alias("o"), T.dropout(x, 0.5).alias("d")).collect()
    assert got[0]["r"] == [0, 2, 0.5] and got[0]["a"] == 1 and got[0]["o"] == [0, 1, 0] and got[0]["d"] == [-1, 2, 0.5]
    v = np.array([-1, 2, 0.5])
    assert np.allclose(got[0]["s"], v - np.log(np.exp(v).sum())) and np.allclose(got[0]["n"], v / np.linalg.norm(v)) and got[1]["n"] == [0, 0, 0]
    assert T.accuracy(df, "x").first()[0] == 0.5
    dropped = df.select(T.dropout(F.array_repeat(F.lit(1.0), 400), 0.25, training=True, seed=3).alias("d")).first()["d"]
    assert set(dropped) <= {0.0, 1 / 0.75}
    assert [r["split"] for r in T.splits(spark.range(1600).withColumnRenamed("id", "vid")).where("vid in (0, 139, 150, 200, 499, 500, 1499, 1500)").orderBy("vid").collect()] == ["train", "train", None, "val", "val", "test", "test", None]
