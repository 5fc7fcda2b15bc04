"""Two-layer graph convolution, inference only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tensor import dropout, log_softmax, plus, relu
from ..operators.linalg import row_normalised, spmm_arrays, symmetrised, times_small
from .module import Module, uniform


class GraphConvolution(Module):
    """X -> A (X W) or (A X) W, with a bias if asked for.

    The product with W comes first where it narrows the arrays, as the arrays are
    what a layer shuffles.
    """

    def __init__(self, n_in: int, n_out: int, bias: bool = False, seed: int = 0):
        super().__init__()
        self.n_in, self.n_out = n_in, n_out
        self.register_parameter("weight", uniform(n_in, n_out, seed))
        self.register_parameter("bias", uniform(1, n_out, seed + 1) if bias else None)

    def forward(self, edges: DataFrame, x: DataFrame) -> DataFrame:
        """(vid, features) of every vertex of ``x``; those without in-edges gather zeros."""
        weight = self.parameter("weight").tolist()
        narrow = self.n_out <= self.n_in
        own = x.select("vid", times_small(F.col("features"), weight).alias("features")) if narrow else x.select("vid", "features")
        width = self.n_out if narrow else self.n_in
        gathered = x.select("vid").join(spmm_arrays(edges, own, width), "vid", "left")
        out = F.coalesce("features", F.array_repeat(F.lit(0.0), width))
        if not narrow:
            out = times_small(out, weight)
        bias = self.parameter("bias")
        if bias is not None:
            out = plus(out, F.array(*[F.lit(float(v)) for v in bias.ravel()]))
        return gathered.select("vid", out.alias("features"))


class GCN(Module):
    """conv2(act(conv1(X))), then the output function.

    The plain form has neither activation nor output function nor bias; the full
    form (:func:`full_gcn`) has ReLU between, a bias in the second layer and
    log-softmax at the end.
    """

    def __init__(self, nfeat: int, nhid: int, nclass: int, drop: float = 0.5, seed: int = 0, activation: Callable | None = None, output: Callable | None = None, bias: bool = False):
        super().__init__()
        self.drop, self.activation, self.output = drop, activation, output
        self.gc1 = self.register_module("gc1", GraphConvolution(nfeat, nhid, False, seed))
        self.gc2 = self.register_module("gc2", GraphConvolution(nhid, nclass, bias, seed + 2))

    def forward(self, edges: DataFrame, x: DataFrame, training: bool = False) -> DataFrame:
        h = self.gc1.forward(edges, x)
        act = F.col("features") if self.activation is None else self.activation(F.col("features"))
        h = h.select("vid", dropout(act, self.drop, training=training).alias("features"))
        out = self.gc2.forward(edges, h)
        return out if self.output is None else out.select("vid", self.output(F.col("features")).alias("features"))


def full_gcn(nfeat: int, nhid: int, nclass: int, drop: float = 0.5, seed: int = 0) -> GCN:
    return GCN(nfeat, nhid, nclass, drop, seed, relu, log_softmax, True)


def propagation(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The full form's adjacency: symmetrised, with loops, rows normalised.

    Rows of the product are targets, so weights are normalised by target.
    """
    a = row_normalised(symmetrised(edges, vertices))
    return a.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def module_forward(model: Module, edges: DataFrame, x: DataFrame) -> DataFrame:
    """Runs a model once: one pass, no loop."""
    return model.forward(edges, x)
