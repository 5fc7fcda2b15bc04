"""Audio features of media columns: log-mel tensors and energy segments.

A clip's samples are resampled with a polyphase windowed-sinc filter, framed with
overlap into log-mel filterbank energies, and cut by hysteresis on the frame
energy: a segment begins where the energy exceeds a high threshold above the
clip's noise floor and extends both ways while it exceeds a low one.

Features come in tensors of one shape, ``frames`` x ``mels``; with a tensor go the
time span it covers and how many of its frames are filled.  A DataFrame, which has
no tensor type, carries them row by row in a list column;
:func:`write_tensors` stores them as Arrow's fixed-shape tensors in Arrow files,
which :func:`read_tensors` and any Arrow reader give back as such.

Defined results
---------------
* a null or empty clip, or one without a whole sample, gives one row with no tensor
  and no segments, so that no clip is lost;
* the last frame of a clip is filled up with silence, so every sample is in a frame
  and the shortest clip has one; its last tensor is filled up with the floor value;
* a very long clip is analysed whole, in time and memory linear in its length;
* where levels are equal throughout no frame is above the floor, and there is no segment;
* an empty table gives no rows;
* a repeated row is analysed again; a null id stays null;
* bytes that end within a sample lose that part; only the named columns are read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import workers_import
from .textvec import id_column

FLOOR = 1e-10
_ROWS = "doc_id long, window int, start_s double, end_s double, n_frames int, tensor array<float>, segments array<struct<start_s: double, end_s: double, level_db: float>>"


@lru_cache(maxsize=1)
def _mulaw() -> np.ndarray:
    code = ~np.arange(256, dtype=np.uint8)
    size = (((code & 15).astype(np.int32) << 3) + 132 << ((code >> 4) & 7)) - 132
    return (np.where(code & 128, -size, size) / 32768).astype(np.float32)


def decode(data: bytes | memoryview, encoding: str) -> np.ndarray:
    """Samples in -1..1 of raw mono bytes."""
    if encoding == "mulaw":
        return _mulaw()[np.frombuffer(data, np.uint8)]
    kind, scale, shift = {"u8": (np.uint8, 128, 1.0), "s16": (np.dtype("<i2"), 32768, 0.0), "f32": (np.dtype("<f4"), 1, 0.0)}[encoding]
    size = np.dtype(kind).itemsize
    return np.frombuffer(data[: len(data) // size * size], kind).astype(np.float32) / scale - np.float32(shift)


@lru_cache(maxsize=4)
def polyphase(rate: int, to: int, zeros: int = 12, outputs: int = 32) -> tuple[int, int, int, list[tuple[int, slice, np.ndarray]]]:
    """(inputs and outputs a block, reach, [first input, outputs, matrix]): the filter for a block of outputs.

    Output n lies at input n * down / up; its phase's taps stand in one column.
    A few neighbouring outputs are a product of the inputs that their taps span
    and a small matrix, in which hardly anything is zero.  A low pass at the
    lower of the two Nyquist rates under a Kaiser window.
    """
    common = math.gcd(rate, to)
    up, down = to // common, rate // common
    several = max(1, 128 // up)
    up, down = up * several, down * several
    cut = min(1.0, to / rate)
    reach = math.ceil(zeros / cut)
    parts = []
    for a in range(0, up, outputs):
        at = np.arange(a, min(a + outputs, up)) * down / up
        first = math.floor(at[0])
        x = (np.arange(first - reach, math.floor(at[-1]) + reach + 2)[:, None] - at[None, :]) * cut
        window = np.where(np.abs(x) < zeros, np.i0(8.0 * np.sqrt(np.clip(1 - (x / zeros) ** 2, 0, 1))) / np.i0(8.0), 0)
        parts.append((first, slice(a, a + len(at)), (cut * np.sinc(x) * window).astype(np.float32)))
    return down, up, reach, parts


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """The clip at another rate; ceil(n * to / rate) samples."""
    if rate == to or not len(x):
        return x
    down, up, reach, parts = polyphase(rate, to)
    n = -(-len(x) * to // rate)
    blocks = -(-n // up)
    padded = np.zeros(blocks * down + 2 * reach + 2, np.float32)
    padded[reach : reach + len(x)] = x[: len(padded) - reach]
    out = np.empty((blocks, up), np.float32)
    for first, where, matrix in parts:
        rows = np.lib.stride_tricks.as_strided(padded[first:], (blocks, len(matrix)), (4 * down, 4), writeable=False)
        for a in range(0, blocks, 4096):
            out[a : a + 4096, where] = rows[a : a + 4096] @ matrix
    return out.ravel()[:n]


@lru_cache(maxsize=4)
def filterbank(rate: int, size: int, mels: int, low: float, high: float) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale: bins x mels."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(low), mel(high), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(size, 1 / rate)[:, None]
    left, mid, right = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - left) / (mid - left), (right - f) / (right - mid))).astype(np.float32)


def log_mel(x: np.ndarray, rate: int, *, frame: int, hop: int, size: int, mels: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel energies, frame levels in dB) of overlapping Hann frames, the last one filled up with silence."""
    if not len(x):
        return np.zeros((0, mels), np.float32), np.zeros(0, np.float32)
    more = max(0, -(-(len(x) - frame) // hop)) * hop + frame - len(x)
    if more:
        x = np.concatenate([x, np.zeros(more, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]
    window = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)).astype(np.float32)
    bank = filterbank(rate, size, mels, 20.0, rate / 2)
    out, level = np.empty((len(frames), mels), np.float32), np.empty(len(frames), np.float32)
    for a in range(0, len(frames), block):
        part = frames[a : a + block] * window
        spectrum = np.fft.rfft(part, size, axis=1)
        power = spectrum.real**2
        power += spectrum.imag**2
        np.log(np.maximum(power.astype(np.float32, copy=False) @ bank, FLOOR), out=out[a : a + block])
        level[a : a + block] = 10 * np.log10(np.maximum(np.einsum("ij,ij->i", part, part) / frame, FLOOR))
    return out, level


def hysteresis(level: np.ndarray, *, high_db: float, low_db: float, least: int) -> list[tuple[int, int, float]]:
    """(first frame, end, mean level) of segments.

    Runs above the low threshold that somewhere exceed the high one, at least
    ``least`` frames long; thresholds are above the tenth percentile of the levels.
    """
    if not len(level):
        return []
    floor = np.percentile(level, 10)
    edge = np.diff(np.concatenate([[0], (level > floor + low_db).astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    loud = np.concatenate([[0], np.cumsum(level > floor + high_db)])
    sums = np.concatenate([[0], np.cumsum(level, dtype=np.float64)])
    keep = (loud[ends] > loud[starts]) & (ends - starts >= least)
    return [(int(a), int(b), float((sums[b] - sums[a]) / (b - a))) for a, b in zip(starts[keep], ends[keep])]


def _analyse(rate: int, encoding: str, to: int, mels: int, frames: int, high_db: float, low_db: float, least: int):
    frame, hop, size = to // 40, to // 100, 1 << (to // 40 - 1).bit_length()
    tensor = pa.list_(pa.float32())
    segment = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("level_db", pa.float32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, heads, values, spans, filled = [], [], [], [], []

        def out() -> pa.RecordBatch:
            n = len(ids)
            has = np.array([h is not None for h in heads])
            ends = np.concatenate([[0], np.cumsum(np.where(has, frames * mels, 0))]).astype(np.int32)
            flat = np.concatenate(values) if values else np.zeros(0, np.float32)
            lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.concatenate([~has, [False]])), pa.array(flat))
            begin, end = ([None if h is None else h[k] for h in heads] for k in (1, 2))
            columns = [pa.array(ids, pa.int64()), pa.array([None if h is None else h[0] for h in heads], pa.int32()), pa.array(begin, pa.float64()), pa.array(end, pa.float64()), pa.array(filled, pa.int32()), lists.cast(tensor), pa.array(spans, segment)]
            for x in (ids, heads, values, spans, filled):
                x.clear()
            assert n == len(columns[0])
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "window", "start_s", "end_s", "n_frames", "tensor", "segments"])

        for batch in batches:
            for doc, clip in zip(id_column(batch, "id"), id_column(batch, "clip")):
                data = clip.as_buffer() if clip.is_valid else b""
                mel, level = log_mel(resample(decode(memoryview(data), encoding), rate, to), to, frame=frame, hop=hop, size=size, mels=mels)
                at = 0
                parts = [(a * hop / to, ((b - 1) * hop + frame) / to, db) for a, b, db in hysteresis(level, high_db=high_db, low_db=low_db, least=least)]
                if not len(mel):
                    ids.append(doc.as_py())
                    heads.append(None)
                    spans.append([])
                    filled.append(0)
                for w, a in enumerate(range(0, len(mel), frames)):
                    part = mel[a : a + frames]
                    begin, end = a * hop / to, ((a + len(part) - 1) * hop + frame) / to
                    values.append(part.ravel())
                    if len(part) < frames:
                        values.append(np.full((frames - len(part)) * mels, math.log(FLOOR), np.float32))
                    ids.append(doc.as_py())
                    heads.append((w, begin, end))
                    filled.append(len(part))
                    own = at
                    while at < len(parts) and parts[at][0] < (a + frames) * hop / to:
                        at += 1
                    spans.append([{"start_s": s, "end_s": e, "level_db": db} for s, e, db in parts[own:at]])
                    if len(ids) >= 64:
                        yield out()
        if ids:
            yield out()

    return run


def audio_features(
    media: DataFrame, *, id_col: str = "doc_id", clip_col: str = "clip", rate: int = 22_050, encoding: str = "mulaw", to: int = 16_000,
    mels: int = 40, frames: int = 32, high_db: float = 6.0, low_db: float = 3.0, least: int = 5,
) -> DataFrame:
    """Windows of log-mel features of every clip, with the segments that begin in them.

    ``clip_col`` holds raw mono samples as binary, at ``rate`` and in ``encoding``
    (mulaw, u8, s16 or f32).  Frames are 25 ms long and begin every 10 ms.
    """
    workers_import(media.sparkSession)
    own = media.select(F.col(id_col).cast("long").alias("id"), F.col(clip_col).cast("binary").alias("clip"))
    return own.mapInArrow(_analyse(rate, encoding, to, mels, frames, high_db, low_db, least), _ROWS)


def to_tensors(column: pa.Array | pa.ChunkedArray, mels: int = 40, frames: int = 32) -> pa.Array:
    """The tensor column as an Arrow array of fixed-shape tensors; null rows stay null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.fixed_shape_tensor(pa.float32(), (frames, mels), dim_names=("frame", "mel"))
    return pa.ExtensionArray.from_storage(kind, column.cast(pa.list_(pa.float32(), frames * mels)))


def _place(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def write_tensors(features: DataFrame, path: str, mels: int = 40, frames: int = 32) -> DataFrame:
    """Store features in Arrow files whose tensor column has the fixed-shape tensor
    type; gives (file, rows), a row for each file of the table.  (Parquet can't
    give back lists of fixed size that are null.)

    ``path`` is a folder that all executors share.  A task writes a file under a
    name of its own and the driver's rows name those that count, so that a task
    that was lost or ran twice adds nothing; others are deleted.
    """
    workers_import(features.sparkSession)
    fs, folder = _place(path)
    fs.create_dir(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, writer, rows = f"{uuid.uuid4().hex}.arrow", None, 0
        own, there = _place(path)
        for batch in batches:
            at = batch.schema.get_field_index("tensor")
            tensor = to_tensors(batch.column(at), mels, frames)
            batch = batch.set_column(at, pa.field("tensor", tensor.type), tensor)
            if writer is None:
                sink = own.open_output_stream(f"{there}/{name}")
                writer = pa.ipc.new_file(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows])], names=["file", "rows"])

    done = features.mapInArrow(run, "file string, rows long").collect()  # a row for each task
    files = {r["file"] for r in done}
    for info in fs.get_file_info(pa.fs.FileSelector(folder)):
        if info.base_name.endswith(".arrow") and info.base_name not in files:
            fs.delete_file(info.path)
    return features.sparkSession.createDataFrame([(r["file"], r["rows"]) for r in done], "file string, rows long")


def read_tensors(path: str) -> pa.Table:
    """The stored features, with their tensor column of fixed shape."""
    fs, folder = _place(path)
    return pa.dataset.dataset(folder, filesystem=fs, format="ipc").to_table()
