"""Goldens, agreement of the formulations, and properties of the graph engine."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from meshwright.functions.semiring import MIN_PLUS, PLUS_TIMES
from meshwright.graph import ADVANCE_VIEWS, BLAS_VIEWS, Graph, Views
from meshwright.operators import linalg as L
from meshwright.operators import primitives as P
from meshwright.operators.engine import AdvanceProgram, BlasProgram, Component, DivergedError, activated, frontier_degree_sum, run
from meshwright.operators.frontier import AllActiveFrontier, DenseFrontier, SparseFrontier
from meshwright.plans.pagerank import pagerank
from meshwright.plans.sssp import sssp_advance, sssp_blas_dense, sssp_blas_sparse
from meshwright.sources.options import LoadOptions

TOY = "0 1 4\n0 2 1\n2 1 2\n1 3 5\n2 3 8\n4 3 3\n3 3 7\n0 1 9\n% c\n\n"
ALL = (sssp_advance, sssp_blas_sparse, sssp_blas_dense)


@pytest.fixture
def toy(spark, tmp_path):
    (tmp_path / "toy.adj").write_text(TOY)
    return lambda **options: Graph.load(spark, str(tmp_path / "toy.adj"), LoadOptions(**options))


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_toy_edges(toy):
    g = toy(directed=True)
    assert rows(g.edges) == [(0, 1, 4.0), (0, 2, 1.0), (1, 3, 5.0), (2, 1, 2.0), (2, 3, 8.0), (4, 3, 3.0)]
    assert tuple(g.size()) == (4, 5, 6) and tuple(toy().size()) == (4, 5, 12)


@pytest.mark.parametrize("f", ALL)
@pytest.mark.parametrize(("directed", "want"), [(True, [0, 3, 1, 8, None]), (False, [0, 3, 1, 8, 11])])
def test_toy_paths(toy, f, directed, want):
    assert [r[1] for r in rows(f(toy(directed=directed), 0), "vid")] == want


def test_toy_pagerank(toy):
    want = [0.03, 0.056367, 0.0351, 0.12728, 0.03]
    for result in ("latest", "previous"):
        got = [r[1] for r in rows(pagerank(toy(directed=True), result=result), "vid")]
        assert got == pytest.approx(want, abs=1e-6)


def random_graph(spark, seed, n=25, m=90):
    rng = random.Random(seed)
    edges = {(rng.randrange(n), rng.randrange(n)): rng.randint(1, 20) for _ in range(m)}
    edges = {k: v for k, v in edges.items() if k[0] != k[1]}
    return Graph(spark.createDataFrame([(*k, v) for k, v in edges.items()], "src long, dst long, weight long")), edges


def bellman_ford(edges, source, n):
    dist = {source: 0}
    for _ in range(n):
        for (a, b), w in edges.items():
            if a in dist and dist[a] + w < dist.get(b, 10**9):
                dist[b] = dist[a] + w
    return dist


def test_formulations_agree(spark):
    g, edges = random_graph(spark, 5)
    want = bellman_ford(edges, 3, 25)
    for f in ALL:
        got = {r["vid"]: r["dist"] for r in f(g, 3).collect()}
        assert {v: d for v, d in got.items() if d is not None} == want
        assert all(b not in want or a not in want or want[b] <= want[a] + w for (a, b), w in edges.items())


def test_salts_dont_matter(spark):
    g, edges = random_graph(spark, 6)
    for f in ALL:
        assert rows(f(g, 3, salts=3), "vid") == rows(f(g, 3), "vid")
    assert [r[1] for r in rows(pagerank(g, iterations=3, salts=4), "vid")] == pytest.approx([r[1] for r in rows(pagerank(g, iterations=3), "vid")])


@pytest.mark.parametrize("kind", ["int", "long", "float", "double"])
def test_blocks_dont_matter(spark, kind):
    g, edges = random_graph(spark, 11, n=60, m=220)
    g = Graph(g.edges.withColumn("weight", F.col("weight").cast(kind)))
    want = bellman_ford(edges, 3, 60)
    for size in (1, 17, 60, None):
        assert {r["vid"]: r["dist"] for r in sssp_blas_dense(g, 3, block_edges=size).collect() if r["dist"] is not None} == want


def test_long_paths_take_a_round_a_block(spark):
    n = 400
    e = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), (F.col("id") % 3 + 1).alias("weight"))
    want = [(v, sum(i % 3 + 1 for i in range(v))) for v in range(n + 1)]
    for f in ALL:
        assert rows(f(Graph(e), 0, max_iterations=3), "vid") == want
        assert rows(f(Graph(e), 0, max_iterations=6, block_edges=100), "vid") == want


def test_hubs_and_odd_weights_go_without_blocks(spark):
    hub = spark.range(1, 40).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(2).cast("long").alias("weight"))
    tail = spark.range(40, 50).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"), F.lit(1).cast("long").alias("weight"))
    got = rows(sssp_advance(Graph(hub.union(tail)), 0, block_edges=8), "vid")
    assert got == [(0, 0)] + [(v, 2) for v in range(1, 40)] + [(v, v - 37) for v in range(40, 50)]
    odd = spark.createDataFrame([(0, 1, float("inf")), (0, 2, 1.0), (2, 3, None), (2, 4, 2.0)], "src long, dst long, weight double")
    assert rows(sssp_advance(Graph(odd), 0), "vid") == [(0, 0.0), (1, float("inf")), (2, 1.0), (3, None), (4, 3.0)]
    null = odd.where("dst <> 1")
    assert rows(sssp_advance(Graph(null), 0), "vid") == [(0, 0.0), (1, None), (2, 1.0), (3, None), (4, 3.0)]


def test_negative_weights_in_blocks(spark):
    e = [(0, 1, 5), (0, 2, 2), (2, 1, -4), (1, 3, 1), (3, 4, 2), (4, 2, 3)]
    g = Graph(spark.createDataFrame(e, "src long, dst long, weight long"))
    for size in (2, None):
        assert rows(sssp_blas_sparse(g, 0, block_edges=size), "vid") == [(0, 0), (1, -2), (2, 2), (3, -1), (4, 1)]
        with pytest.raises(DivergedError):
            sssp_blas_dense(Graph(g.edges.withColumn("weight", F.when(F.col("src") == 4, -3).otherwise(F.col("weight")))), 0, block_edges=size)


def test_superseded_states_go(spark):
    import pathlib

    root = pathlib.Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    count = lambda: len(list(root.glob("*/rdd-*")))
    before = count()
    sssp_advance(random_graph(spark, 7)[0], 3).collect()
    assert count() == before + 1


def test_rank_sum(spark):
    ring = Graph(spark.createDataFrame([(i, (i + 1) % 9, 1 + i) for i in range(9)] + [(i, (i + 4) % 9, 2) for i in range(9)], "src long, dst long, weight long"))
    assert pagerank(ring).agg(F.sum("rank")).first()[0] == pytest.approx(1)
    g, edges = random_graph(spark, 8, m=30)
    total = pagerank(g).agg(F.sum("rank")).first()[0]
    assert total <= 1 + 1e-9


def test_pagerank_modes(spark):
    g, _ = random_graph(spark, 2)
    assert rows(pagerank(g, compat=True, eps=0.5), "vid") == [(v, 1 / 25) for v in range(25)]  # 1/V is within eps already
    assert rows(pagerank(g, eps=0.5), "vid") != [(v, 1 / 25) for v in range(25)]
    before, after = (rows(pagerank(g, iterations=n, result=r), "vid") for n, r in ((3, "latest"), (4, "previous")))
    assert [x[1] for x in before] == pytest.approx([x[1] for x in after])


def test_negative_cycle(spark):
    g = Graph(spark.createDataFrame([(0, 1, -1), (1, 0, -1)], "src long, dst long, weight long"))
    with pytest.raises(DivergedError):
        sssp_advance(g, 0)


def test_unknown_source(toy):
    with pytest.raises(KeyError):
        sssp_advance(toy(), 77)


def test_reorder_reports_original_ids(spark, tmp_path):
    (tmp_path / "g.adj").write_text("50 7 2\n7 900 3\n900 900 1\n")
    g = Graph.load(spark, str(tmp_path / "g.adj"), LoadOptions(directed=True, reorder=True))
    assert rows(g.ids, "vid") == [(50, 0), (7, 1), (900, 2)]
    assert rows(sssp_advance(g, 50), "vid") == [(7, 2.0), (50, 0.0), (900, 5.0)]
    assert rows(sssp_advance(g, 0, original=False), "vid") == [(0, 0.0), (1, 2.0), (2, 5.0)]


def test_many_ids_take_no_job_each(spark):
    ids = spark.range(5000).select((F.col("id") * 3).alias("orig_id"), F.col("id").alias("vid"))
    g = Graph(spark.createDataFrame([(0, 1)], "src long, dst long"), ids.select("vid"), ids=ids)
    wanted = spark.createDataFrame([(9,), (9,), (-5,), (4,), (14997,), (None,)], "orig_id long")
    assert sorted(map(tuple, g.lookup(wanted).collect()), key=str) == sorted([(9, 3), (9, 3), (-5, None), (4, None), (14997, 4999), (None, None)], key=str)
    assert rows(Graph(g.edges).lookup(wanted.where("orig_id is not null")).where("vid is not null")) == []
    assert all((r["vid"] is None) == (r["orig_id"] == -5) for r in g.lookup(wanted.where("orig_id in (9, -5)")).collect())
    assert g.find(9) == 3 and pytest.raises(KeyError, g.find, -5)


def test_id_lookup_jobs_dont_grow_with_its_ids(spark, tmp_path):
    from meshwright.plans.queries import id_lookup

    def jobs(n):
        at = F.timestamp_seconds(F.col("id") * 3600)
        spark.range(n).select(F.col("id").alias("event_id"), at.alias("ts"), F.col("id").alias("user_id"), F.lit(1.0).alias("value")).write.parquet(f"{tmp_path}/{n}/events.parquet")
        spark.sparkContext.setJobGroup(f"lookup {n}", "")
        try:
            found = {r["orig_id"]: r["vid"] for r in id_lookup(spark, f"{tmp_path}/{n}").collect()}
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        assert found == {i: i for i in range(7, n, 40)} | {-5: None}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"lookup {n}"))

    assert jobs(1200) <= jobs(80) + 3  # the adaptive planner's stages may differ


def test_views(spark):
    assert Views(10).first() is Views.CSR and (Views.NORMAL | Views.TRANSPOSE).first() is Views.TRANSPOSE
    assert ADVANCE_VIEWS.has_all(Views.NORMAL) and not ADVANCE_VIEWS.has_some(Views.TRANSPOSE) and BLAS_VIEWS.has_some(Views.TRANSPOSE | Views.COO)
    g = Graph(spark.createDataFrame([(0, 1)], "src long, dst long"), views=ADVANCE_VIEWS)
    assert rows(g.out_degree()) == [(0, 1), (1, 0)] and rows(g.edges) == [(0, 1, 1.0)]
    for f in (g.in_degree, g.by_target):
        with pytest.raises(ValueError):
            f()
    assert g.by_source(3).rdd.getNumPartitions() == 3
    with pytest.raises(TypeError):
        Graph(spark.createDataFrame([("a", "b")], "src string, dst string"))


def test_structure(spark):
    g, edges = random_graph(spark, 1)
    assert rows(g.transpose().transpose().edges) == rows(g.edges)
    offsets = L.indices_to_offsets(g.edges, 25, "src")
    assert rows(offsets) == rows(L.indices_to_offsets_by_search(g.edges, 25, "src"))
    back = [r[1] for r in rows(L.offsets_to_indices(offsets), "position")]
    assert back == sorted(a for a, _ in edges)
    adjacency = {r["vid"]: [n["vid"] for n in r["neighbours"]] for r in g.adjacency(transpose=True).collect()}
    assert adjacency == {v: sorted(a for a, b in edges if b == v) for v in {b for _, b in edges}}
    assert [r[3] for r in rows(g.numbered_edges(), "src", "dst")] == list(range(len(edges)))


def test_empty_graph(spark):
    g = Graph(spark.createDataFrame([], "src long, dst long, weight double"))
    assert tuple(g.size()) == (None, 0, 0) and rows(g.out_degree()) == [] and rows(pagerank(g)) == []


def test_properties(spark):
    g = Graph(spark.createDataFrame([(0, 1)], "src long, dst long"))
    two = spark.createDataFrame([(0, 5), (1, 6)], "vid long, x int")
    assert rows(g.with_properties(two).vertices) == [(0, 5), (1, 6)]
    with pytest.raises(ValueError):
        g.with_properties(two.where("vid = 0"))


def test_from_edges(spark):
    e = spark.createDataFrame([(0, 1, 5, 1), (0, 1, 2, 2), (1, 1, 3, 3), (1, 0, 9, 4)], "src long, dst long, weight long, pos int")
    g = Graph.from_edges(e, directed=False, keep_self_loops=False, keep_duplicates=False)
    assert rows(g.edges) == [(0, 1, 5), (1, 0, 5)]
    assert Graph.from_edges(e).size()["num_edges"] == 4


def test_frontiers(spark):
    g, edges = random_graph(spark, 4)
    v = g.vertices
    assert rows(SparseFrontier([1, 2]).initial(v).where("active").select("vid")) == [(1,), (2,)]
    assert rows(activated(DenseFrontier(v.where("vid < 4")).initial(v))) == [(4,)]
    assert rows(activated(AllActiveFrontier([1]).initial(v))) == [(25,)] and not AllActiveFrontier().converged()
    assert frontier_degree_sum(g, v.where("vid < 4")).first()[0] == sum(a < 4 for a, _ in edges)


class _Reach(Component):
    def init(self):
        return self.graph.vertices.select("vid", (F.col("vid") == 0).alias("seen"))


def test_advance_and_drop(spark):
    g = Graph(spark.createDataFrame([(0, 1), (1, 2), (2, 3), (1, 4), (4, 5)], "src long, dst long"))
    program = AdvanceProgram(message=lambda: F.lit(True), reduce=F.bool_or, update=lambda: {"seen": F.col("seen") | F.coalesce("message", F.lit(False))}, activate=lambda: ~F.col("seen"), advance=lambda: F.col("dst") != 5, drop=lambda: F.col("vid") == 2)
    got = run(_Reach(g), SparseFrontier([0]), program)
    assert [r["vid"] for r in got.where("seen").orderBy("vid").collect()] == [0, 1, 2, 4]
    with pytest.raises(ValueError):
        run(_Reach(g), DenseFrontier([0]), program)


def test_default_result_gates_sparse_but_not_all_active(spark):
    g = Graph(spark.createDataFrame([(0, 1, 0), (2, 3, 1)], "src long, dst long, weight long"))

    class Count(Component):
        def init(self):
            return self.graph.vertices.select("vid", F.lit(7).cast("long").alias("x"))

    program = BlasProgram(gather=PLUS_TIMES, construct=lambda: F.lit(1), update=lambda: {"x": F.col("result").cast("long")}, activate=lambda: F.lit(False), default_result=0)
    assert [r[1] for r in rows(run(Count(g), SparseFrontier(), program).select("vid", "x"), "vid")] == [7, 7, 7, 1]
    assert [r[1] for r in rows(run(Count(g), AllActiveFrontier(), program, fixed_iterations=1).select("vid", "x"), "vid")] == [0, 0, 0, 1]


def test_products(spark):
    g, edges = random_graph(spark, 9)
    x = g.vertices.select("vid", (F.col("vid") + 1).alias("val"))
    got = dict(rows(L.spmv(g.edges, x, MIN_PLUS), "vid"))
    want = {}
    for (a, b), w in edges.items():
        want[b] = min(want.get(b, 10**9), w + a + 1)
    assert got == want
    full = dict(rows(L.spmv(g.edges, x, vertices=g.vertices), "vid"))
    assert full == {v: sum(w * (a + 1) for (a, b), w in edges.items() if b == v) for v in range(25)}
    small = spark.createDataFrame([(1, [1.0, 2.0])], "vid long, features array<double>")
    assert rows(small.select(L.times_small(F.col("features"), [[1.0, 0.0, 2.0], [3.0, 1.0, 0.0]]).alias("y"))) == [([7.0, 2.0, 2.0],)]


@pytest.mark.parametrize("n", [0, 1, 100])
def test_scans(spark, n):
    rng = random.Random(n)
    data = [(i, rng.randint(-5, 5)) for i in range(n)]
    df = spark.createDataFrame(data, "i long, x long").repartition(3)
    total, highest, s, h = 0, -100, [], []
    for _, x in data:
        total, highest = total + x, max(highest, x)
        s.append(total)
        h.append(highest)
    assert [r["s"] for r in P.inclusive_scan(df, "x", "s", "i").orderBy("i").collect()] == s
    assert [r["h"] for r in P.inclusive_scan(df, "x", "h", "i", reduce=F.max, combine=F.greatest).orderBy("i").collect()] == h
    values, queries = df, spark.createDataFrame([(q,) for q in range(-7, 8)], "q long")
    assert dict(rows(P.lower_bound(values, queries, "x", "q"), "q")) == {q: sum(x < q for _, x in data) for q in range(-7, 8)}
    assert [r["k"] for r in P.with_index(df, "k", F.desc("i")).orderBy(F.desc("i")).collect()] == list(range(n))


def test_wide_arrays_are_summed_in_segments(spark):
    rng, width = random.Random(3), 2 * L.SEGMENT + 3
    edges = [(rng.randrange(12), rng.randrange(9), float(rng.randrange(1, 5))) for _ in range(60)]
    x = {v: [float(rng.randrange(-9, 9)) for _ in range(width)] for v in range(12)}
    want = {}
    for s, d, w in edges:
        want[d] = [a + w * b for a, b in zip(want.get(d, [0.0] * width), x[s])]
    for n in (width, L.SEGMENT, 1):
        features = spark.createDataFrame([(v, a[:n]) for v, a in x.items()], "vid long, features array<double>")
        got = L.spmm_arrays(spark.createDataFrame(edges, "src long, dst long, weight double"), features, n).collect()
        assert {r["vid"]: r["features"] for r in got} == {d: a[:n] for d, a in want.items()}
