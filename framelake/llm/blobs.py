"""Arrays of numbers and batches of texts as compressed bytes, for exchanges in which a row carries many values.

An exchange has two sides: batches (some megabytes of whole documents, in the order of the scan) ask, shards (by hash of what is asked about) answer. A batch
asks about each different value once, so that a value of a third of all rows is asked about once per batch. Both sides hold one batch or one shard at a time.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import pick, texts_as_bytes

#: Bytes of text that a batch has at least, unless its task ends.
BATCH_BYTES = 2_000_000
#: What stands for a null doc_id: less than any other.
NO_ID = -(2**63)


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as bytes, plane by plane (all lowest bytes first), so that numbers smaller than their type cost little."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        kind = a.dtype.str.encode()
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
        out += [struct.pack("<BQ", len(kind), len(a)), kind, planes]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    data, at = zstandard.ZstdDecompressor().decompress(blob), 4
    out = []
    for _ in range(struct.unpack_from("<I", data)[0]):
        size, n = struct.unpack_from("<BQ", data, at)
        kind = np.dtype(data[at + 9 : at + 9 + size].decode())
        at += 9 + size
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def deltas(ordered: np.ndarray) -> np.ndarray:
    return np.diff(ordered, prepend=ordered.dtype.type(0))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_batches(docs: DataFrame, made, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """batch, and the columns of ``made`` (schema, function) for batches of whole documents: function(ids, texts) gives a row's values.

    ids: doc_ids, NO_ID for null; texts: bytes. A batch's number is that of its partition and its place there: the same in every run over the same files.
    """
    schema, function = made

    def run(record_batches):
        base, n = TaskContext.get().partitionId() << 32, 0
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def row():
            values = function(np.array(ids, dtype=np.int64), texts)
            return pa.RecordBatch.from_pylist([{"batch": base + n} | values], schema=arrow)

        for batch in record_batches:
            for i, t in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), strict=True):
                ids.append(NO_ID if i is None else i)
                texts.append(t)
                size += len(t) + 100
                if size >= batch_bytes:
                    yield row()
                    n, ids, texts, size = n + 1, [], [], 0
        if ids:
            yield row()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(f"batch bigint, {schema}")
    arrow = to_arrow_schema(kind)
    return pick(docs, "doc_id", "text").mapInArrow(run, kind)


def shard_count(spark, size: int, each: int) -> int:
    """Shards of about ``each``, as many as there are shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def by_shard(keys: np.ndarray, shards: int, bits: int = 48) -> np.ndarray:
    """Where each shard's part begins among ordered keys of that many bits; the last entry is the number of keys."""
    edges = np.array([(i << bits) // shards for i in range(shards)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def union_of(*frames: DataFrame) -> DataFrame:
    """batch, kind (the place of the frame), part, blob: what a batch's task needs, to be grouped by batch."""
    out = None
    for kind, frame in enumerate(frames):
        part = frame.select("batch", F.lit(kind).alias("kind"), F.col("part").cast("int").alias("part") if "part" in frame.columns else F.lit(0).alias("part"), "blob")
        out = part if out is None else out.unionByName(part)
    return out
