"""Command-line programs: ``python -m meshwright PROGRAM -i EDGES [-o OUT] ...``.

Programs: sssp_advance, sssp_blas_sparse, sssp_blas_dense, pagerank, gcn.
The output is one text file: the time that the run took, then a line a vertex.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.tensor import argmax
from .gnn.gcn import GCN, module_forward
from .gnn.module import build_module
from .graph import Graph
from .plans.pagerank import pagerank
from .plans.sssp import sssp_advance, sssp_blas_dense, sssp_blas_sparse
from .sources.loader import load_state_dict, load_vertices, numbers
from .sources.onnx import load_initializers
from .sources.options import argument_parser, from_arguments
from .sources.sinks import write_report

#: Stands for an unreached vertex in text output: the greatest 32-bit float.
UNREACHED = 3.4028234663852886e38
PATHS = {f.__name__: f for f in (sssp_advance, sssp_blas_sparse, sssp_blas_dense)}


def _gcn(graph: Graph, args) -> DataFrame:
    """Classes by a network whose vertex file has features and, last, a label."""
    parse = lambda t: {"features": numbers()(F.slice(t, 1, F.size(t) - 1)), "label": F.element_at(t, -1)}
    x = load_vertices(graph.spark, args.features, parse, ids=graph.ids)
    model = build_module(GCN, args.config)
    if args.model:
        model.load_state_dict(load_initializers(args.model) if args.model.endswith(".onnx") else load_state_dict(args.model))
    return module_forward(model, graph.edges, x).select("vid", argmax(F.col("features")).alias("class"))


def main(argv: list[str]) -> int:
    if not argv or argv[0] not in {*PATHS, "pagerank", "gcn"}:
        print(__doc__)
        return 2
    program = argv[0]
    extra = {"src": (int, 0)} if program in PATHS else {"alpha": (float, 0.85)} if program == "pagerank" else {"features": (str, None), "config": (str, None), "model": (str, None)}
    args = argument_parser(**extra).parse_args(argv[1:])
    spark = SparkSession.builder.appName(program).getOrCreate()
    graph = Graph.load(spark, args.input, from_arguments(args))
    began = time.time()
    if program in PATHS:
        result, value, missing = PATHS[program](graph, args.src), "dist", UNREACHED
    elif program == "pagerank":
        result, value, missing = pagerank(graph, alpha=args.alpha), "rank", None
    else:
        result, value, missing = _gcn(graph, args), "class", None
    result = result.cache()
    result.count()
    elapsed = 1000 * (time.time() - began)
    if args.output:
        write_report(result, args.output, "vid", value, elapsed, missing=missing)
    else:
        print(f"Elapsed time: {elapsed:.0f} ms")
        result.orderBy("vid").show()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
