"""Initializers of ONNX models, read from the protocol-buffer wire format.

No ONNX library is needed: only the few fields that hold parameters and the
graph's outline are looked at, by their public field numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np

TYPES = {1: np.dtype("<f4"), 6: np.dtype("<i4"), 12: np.dtype("<u4")}


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if not b & 128:
            return value, at
        shift += 7


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(field number, value) of a message; fixed-width and nested values as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        elif wire == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("a message is cut short")
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire} isn't supported")
        yield key >> 3, value


def _graph(path: str) -> memoryview:
    for number, value in fields(memoryview(Path(path).read_bytes())):
        if number == 7:
            return value
    raise ValueError(f"{path} holds no graph")


def _packed(value: int | memoryview) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        v, at = _varint(value, at)
        out.append(v)
    return out


def _tensor(data: memoryview) -> tuple[str, np.ndarray]:
    name, kind, dims, raw, own = "", 0, [], None, []
    for number, value in fields(data):
        if number == 1:
            dims += _packed(value)
        elif number == 2:
            kind = value
        elif number == 4:
            own.append(np.frombuffer(value, "<f4"))
        elif number == 8:
            name = bytes(value).decode()
        elif number == 9:
            raw = bytes(value)
    if kind not in TYPES:
        raise TypeError(f"{name}: element type {kind} isn't supported")
    if len(dims) not in (1, 2):
        raise ValueError(f"{name}: rank {len(dims)} isn't supported")
    values = np.frombuffer(raw, TYPES[kind]) if raw is not None and len(raw) == TYPES[kind].itemsize * int(np.prod(dims)) else np.concatenate(own) if own and raw is None else None
    if values is None or len(values) != int(np.prod(dims)):
        raise ValueError(f"{name}: the data don't fill shape {dims}")
    return name, values.reshape(dims if len(dims) == 2 else (1, dims[0]))


def load_initializers(path: str) -> dict[str, np.ndarray]:
    """Named parameters of rank 1 (as one row) or 2, of 32-bit numbers."""
    return dict(_tensor(value) for number, value in fields(_graph(path)) if number == 5)


def outline(path: str) -> list[str]:
    """A line for each parameter and each node of the graph."""
    lines = [f"initializer {n} {a.dtype} {a.shape[0]}x{a.shape[1]}" for n, a in load_initializers(path).items()]
    for number, value in fields(_graph(path)):
        if number == 1:
            parts: dict[int, list[str]] = {}
            for k, v in fields(value):
                if k in (1, 2, 3, 4):
                    parts.setdefault(k, []).append(bytes(v).decode())
            lines.append(f"node {''.join(parts.get(4, []))} {', '.join(parts.get(1, []))} -> {', '.join(parts.get(2, []))}")
    return lines
