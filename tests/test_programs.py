from __future__ import annotations

import json

import numpy as np
import pytest

from meshwright.__main__ import main
from meshwright.sources.onnx import load_initializers, outline


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def tensor(name, a, kind, packed=True):
    dims = field(1, b"".join(varint(d) for d in a.shape)) if packed else b"".join(field(1, d) for d in a.shape)
    return dims + field(2, kind) + field(8, name) + field(9, a.tobytes())


def model(path, *tensors, nodes=()):
    graph = b"".join(field(1, n) for n in nodes) + field(2, "g") + b"".join(field(5, t) for t in tensors)
    path.write_bytes(field(1, 8) + field(2, "test") + field(7, graph))
    return str(path)


def test_initializers(tmp_path):
    a, b = np.arange(6, dtype="<f4").reshape(2, 3), np.arange(200, dtype="<i4")
    node = field(1, "x") + field(1, "w") + field(2, "y") + field(3, "n") + field(4, "MatMul")
    path = model(tmp_path / "m.onnx", tensor("w", a, 1), tensor("b", b, 6, packed=False), nodes=[node])
    got = load_initializers(path)
    assert (got["w"] == a).all() and got["b"].shape == (1, 200) and (got["b"][0] == b).all()
    assert outline(path) == ["initializer w float32 2x3", "initializer b int32 1x200", "node MatMul x, w -> y"]
    floats = field(1, 2) + field(2, 1) + field(8, "f") + field(4, np.array([1, 2], "<f4").tobytes())
    assert load_initializers(model(tmp_path / "f.onnx", floats))["f"].tolist() == [[1, 2]]
    with pytest.raises(TypeError):
        load_initializers(model(tmp_path / "t.onnx", tensor("d", a.astype("<f8"), 11)))
    with pytest.raises(ValueError):
        load_initializers(model(tmp_path / "r.onnx", tensor("d", a.reshape(1, 2, 3), 1)))
    with pytest.raises(ValueError):
        load_initializers(model(tmp_path / "s.onnx", field(1, 9) + field(2, 1) + field(8, "d") + field(9, b"1234")))
    (tmp_path / "e.onnx").write_bytes(field(1, 8))
    with pytest.raises(ValueError):
        load_initializers(str(tmp_path / "e.onnx"))


@pytest.mark.parametrize("program", ["sssp_advance", "sssp_blas_sparse", "sssp_blas_dense"])
def test_paths_program(spark, tmp_path, program):
    (tmp_path / "g.adj").write_text("0 1 4\n0 2 1\n2 1 2\n5 4\n")
    out = tmp_path / "out.txt"
    assert main([program, "-i", str(tmp_path / "g.adj"), "-o", str(out), "-d", "--src", "0"]) == 0
    lines = out.read_text().splitlines()
    assert lines[0].startswith("Elapsed time: ") and lines[1:4] == ["0-0.000000", "1-3.000000", "2-1.000000"] and lines[4].startswith("3-34028234663852886")


def test_rank_and_network_programs(spark, tmp_path):
    (tmp_path / "g.adj").write_text("7 8\n8 9\n9 7\n")
    out = tmp_path / "out.txt"
    assert main(["pagerank", "-i", str(tmp_path / "g.adj"), "-o", str(out), "-r"]) == 0
    assert out.read_text().splitlines()[1:] == ["7-0.333333", "8-0.333333", "9-0.333333"]
    (tmp_path / "v.feat").write_text("7 1 0 0 a\n8 0 1 0 b\n9 0 0 1 a\n")
    (tmp_path / "m.json").write_text(json.dumps({"nfeat": 3, "nhid": 2, "nclass": 2}))
    np.savez(tmp_path / "w.npz", **{"gc1.weight": np.ones((3, 2)), "gc2.weight": np.array([[0.0, 1.0], [0.0, 1.0]])})
    assert main(["gcn", "-i", str(tmp_path / "g.adj"), "-o", str(out), "-r", "--features", str(tmp_path / "v.feat"), "--config", str(tmp_path / "m.json"), "--model", str(tmp_path / "w.npz")]) == 0
    assert out.read_text().splitlines()[1:] == ["0-1.000000", "1-1.000000", "2-1.000000"]
    assert main([]) == 2 and main(["other"]) == 2
