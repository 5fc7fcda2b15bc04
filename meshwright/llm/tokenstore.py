"""Token ids in compressed shards with access to single documents.

Texts become ids of a byte-pair vocabulary, arrays of ids little-endian bytes, and
every array a zstandard frame of its own that shares one trained dictionary.  A
shard is a row: its frames end to end, and for each document its doc_id, its
offset in the payload and its number of tokens.  The dictionary is a row as well,
and every shard carries its hash, so that a frame can't be read with another one.

The dictionary is trained on all documents: groups of them train dictionaries of
their own on the cluster, and pieces of these are what the next level is trained
on.  Texts are encoded once; their ids are kept in the shared folder, from where
they are trained on and compressed.

:func:`write_store` keeps every shard in a row group of its own, beside an index
from doc_id to shard and place that is sorted by doc_id, so :func:`lookup` reads
the shards of the documents asked for and no others.

Defined results
---------------
* a null text is stored with -1 tokens and no bytes, an empty one with 0 tokens;
* repeated rows are stored each, null doc_ids under null; a very long text is one
  frame, and its shard ends behind it;
* an empty table gives the dictionary's row alone; with too little text to train
  on, the dictionary is what text there is, or empty;
* text that isn't in the vocabulary can't occur: ids cover all bytes;
* documents of any doc_id train, those without one as well;
* only the named columns are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import drop_written, workers_import, written
from .textvec import id_column

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SHARD = "shard string, dict_hash string, id_bytes int, payload binary, doc_ids array<long>, offsets array<long>, n_tokens array<long>"
_TOKENS = "id long, n_bytes long, ids binary"
#: What trains a dictionary together has about so many times its bytes (zstandard asks for a hundred).
GROUP = 100
#: Bytes of a segment in dictionaries of groups, about what the trainer chose for them itself (1,511 and 1,998 on check_s).
SEGMENT = 2000


class Encoder:
    """Ids of texts as bytes, and back."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.type = np.dtype("<u2" if max(table.values()) < 1 << 16 else "<u4")

    def __call__(self, text: str) -> bytes:
        return self.coder.encode_to_numpy(text, disallowed_special=()).astype(self.type).tobytes()

    def text(self, ids: bytes) -> str:
        return self.coder.decode(np.frombuffer(ids, self.type).tolist())


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str) -> Encoder:
    return Encoder(ranks, pattern)


def _pieces(arrays: list[bytes], size: int) -> list[bytes]:
    """Arrays cut up for the trainer, which refuses a few large ones, into 32 for a dictionary's size."""
    n = max(256, size // 32)
    return [a[i : i + n] for a in arrays for i in range(0, len(a), n)]


def train(arrays: list[bytes], size: int, segment: int = 0) -> bytes:
    """A shared dictionary; the texts themselves where there are too few to train on.

    All arrays are counted (the trainer would hold back a quarter to choose its
    parameters on); ``segment`` is given where it needn't choose.
    """
    arrays = [a for a in arrays if a]
    given = {"k": min(segment, size // 8), "d": 8} if segment else {}
    for own in (arrays, _pieces(arrays, size)):
        try:
            return zstandard.train_dictionary(size, own, split_point=1.0, **given).as_bytes()
        except zstandard.ZstdError:  # the trainer refuses small samples
            pass
    return b"".join(arrays)[-size:]


def _hash(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def _encoded(ranks, pattern: str):
    """Ids of texts, null of null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value, pattern)
        for batch in batches:
            ids = [None if t is None else encode(t) for t in id_column(batch, "t").to_pylist()]
            yield pa.RecordBatch.from_arrays([id_column(batch, "id"), pa.array([len(x or b"") for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["id", "n_bytes", "ids"])

    return run


def _shards(id_bytes: int, dictionary: bytes, level: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = _hash(dictionary)
        compress = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).compress
        docs, frames, offsets, counts = [], [], [0], []

        def out() -> pa.RecordBatch:
            payload = b"".join(frames)
            row = ([f"{_hash(payload)}-{_hash(np.array([-1 if d is None else d for d in docs]).tobytes())}"], [name], [id_bytes], [payload], [list(docs)], [list(offsets)], [list(counts)])
            kinds = [pa.string(), pa.string(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3]
            docs.clear(), frames.clear(), counts.clear(), offsets.clear(), offsets.append(0)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], names=[x.split()[0] for x in _SHARD.split(", ")])

        for batch in batches:
            for doc, ids in zip(id_column(batch, "id").to_pylist(), id_column(batch, "ids").to_pylist()):
                frame = compress(ids) if ids else b""
                docs.append(doc)
                frames.append(frame)
                offsets.append(offsets[-1] + len(frame))
                counts.append(-1 if ids is None else len(ids) // id_bytes)
                if offsets[-1] >= shard_bytes:
                    yield out()
        if docs:
            yield out()

    return run


def _trained(size: int, segment: int, whole: bool):
    """A dictionary for each group of rows sorted by group, of arrays as they are or of their pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, arrays, held = None, [], 0

        def out() -> pa.RecordBatch:
            own = train(arrays if whole else _pieces(arrays, size), size, segment)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([own], pa.binary())], names=["id", "n_bytes", "ids"])

        for batch in batches:
            for at, ids in zip(id_column(batch, "at").to_pylist(), id_column(batch, "ids").to_pylist()):
                if at != now or held > 4 * GROUP * size:  # a group far beyond the others goes on as another
                    if arrays:
                        yield out()
                    now, arrays, held = at, [], 0
                arrays.append(ids)
                held += len(ids)
        if arrays:
            yield out()

    return run


def dictionary_of(tokens: DataFrame, share: float, least: int, size: int) -> bytes:
    """The shared dictionary, trained on all documents; with a ``share`` below 1, on that share of least hash, and on ``least`` at least."""
    if size <= 0:
        return b""
    rows = tokens.where("n_bytes > 0")
    if share < 1:
        n = rows.count()
        part, slots = min(1.0, max(share, least / n)) if n else 1.0, 1 << 40
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(slots)) < F.lit(int(part * slots)))
    above = None
    while True:
        groups = max(1, -(-(rows.agg(F.sum("n_bytes")).first()[0] or 0) // (GROUP * size)))
        code = F.xxhash64("id", "ids")
        ordered = rows.select(F.pmod(code.bitwiseXOR(F.lit(0x5DEECE66D)), F.lit(groups)).alias("at"), "id", "ids").repartition("at").sortWithinPartitions("at", "id", code).select("at", "ids")
        level = written(ordered.mapInArrow(_trained(size, SEGMENT if groups > 1 else 0, above is None), _TOKENS), "dictionaries")
        if above is not None:
            drop_written(above)
        first = level.limit(2).collect()
        if len(first) < 2:
            drop_written(level)
            return bytes(first[0]["ids"]) if first else b""
        rows = above = level


def _ranks(spark: SparkSession, vocabulary: str):
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def store(
    docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN,
    share: float = 1.0, least: int = 1000, dictionary_bytes: int = 112_640, level: int = 3, shard_bytes: int = 4 << 20,
) -> DataFrame:
    """Shards of all documents, and the dictionary as the shard ``dictionary``.

    The dictionary is trained on all documents, whose ids are shuffled for it.  A
    ``share`` below 1 trains on that part of them, chosen by a hash of the doc_id,
    and on ``least`` of them at least.
    """
    spark = docs.sparkSession
    workers_import(spark)
    ranks = _ranks(spark, vocabulary)
    id_bytes = encoder(ranks.value, pattern).type.itemsize
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    tokens = written(own.mapInArrow(_encoded(ranks, pattern), _TOKENS), "tokens")
    dictionary = dictionary_of(tokens, share, least, dictionary_bytes)
    first = spark.createDataFrame([("dictionary", _hash(dictionary), id_bytes, bytearray(dictionary), [], [0], [])], _SHARD)
    return tokens.select("id", "ids").mapInArrow(_shards(id_bytes, dictionary, level, shard_bytes), _SHARD).union(first)


class Reader:
    """Reads documents of shards, given the dictionary's bytes."""

    def __init__(self, dictionary: bytes):
        self.name = _hash(dictionary)
        self.read = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress

    def ids(self, shard, at: int) -> np.ndarray | None:
        """Token ids of the document at a place of the shard; its frame alone is read."""
        if shard["dict_hash"] != self.name:
            raise ValueError(f"shard {shard['shard']} was written with dictionary {shard['dict_hash']}, not {self.name}")
        if shard["n_tokens"][at] < 0:
            return None
        frame = bytes(shard["payload"][shard["offsets"][at] : shard["offsets"][at + 1]])
        return np.frombuffer(self.read(frame) if frame else b"", f"<u{shard['id_bytes']}")


def documents(shards: DataFrame, vocabulary: str, *, pattern: str = PATTERN, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """(doc_id, ids, text) of stored documents, all or those named."""
    spark = shards.sparkSession
    workers_import(spark)
    ranks = _ranks(spark, vocabulary)
    dictionary = bytes(shards.where("shard = 'dictionary'").first()["payload"])
    wanted = None if doc_ids is None else set(doc_ids)
    rows = shards.where("shard != 'dictionary'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, coder = Reader(dictionary), encoder(ranks.value, pattern)
        for batch in batches:
            for shard in batch.to_pylist():
                at = [i for i, d in enumerate(shard["doc_ids"]) if wanted is None or d in wanted]
                ids = [reader.ids(shard, i) for i in at]
                text = [None if x is None else coder.text(x.astype(coder.type).tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard["doc_ids"][i] for i in at], pa.int64()), pa.array([None if x is None else x.astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array(text, pa.string())],
                    names=["doc_id", "ids", "text"],
                )

    return rows.mapInArrow(run, "doc_id long, ids array<long>, text string")


def index(shards: DataFrame) -> DataFrame:
    """(doc_id, shard, place, start, end, n_tokens) of every stored document: its frame is payload[start:end]."""
    each = shards.where("shard != 'dictionary'").select("shard", "offsets", F.posexplode(F.arrays_zip("doc_ids", "n_tokens")).alias("place", "d"))
    return each.select(F.col("d.doc_ids").alias("doc_id"), "shard", "place", F.get("offsets", F.col("place")).alias("start"), F.get("offsets", F.col("place") + 1).alias("end"), F.col("d.n_tokens").alias("n_tokens"))


def write_store(shards: DataFrame, path: str) -> None:
    """Keep shards and their index as Parquet, a shard in a row group of its own."""
    shards.write.option("parquet.block.size", 1024).option("parquet.page.size.row.check.min", 1).option("parquet.block.size.row.check.min", 1).option("parquet.block.size.row.check.max", 1).parquet(f"{path}/shards")
    kept = shards.sparkSession.read.parquet(f"{path}/shards")
    index(kept).repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{path}/index")


def lookup(spark: SparkSession, path: str, doc_ids: Iterable[int], vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids, text) of the documents named, read from their shards alone."""
    wanted = sorted(set(doc_ids))
    own = spark.read.parquet(f"{path}/index").where(F.col("doc_id").isin(wanted)).select("shard").distinct().collect()  # at most a row for each document asked for
    shards = spark.read.parquet(f"{path}/shards").where(F.col("shard").isin([r["shard"] for r in own] + ["dictionary"]))
    return documents(shards, vocabulary, pattern=pattern, doc_ids=wanted)
