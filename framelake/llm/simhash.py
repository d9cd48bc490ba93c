"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, Hamming distance, components.

The 64 bits are cut into B blocks. Two fingerprints that differ in at most D bits differ in at most D blocks, so that they share
B - D of them: joined on every choice of B - D blocks, no close pair is missed. B grows with the number of different
fingerprints, so that a key has enough bits to tell strangers apart. Each key's fingerprints are compared in numpy;
of what is close only a spanning forest leaves the task, so that a large group of near copies gives as many links as
it has members and not their square. Keys with many fingerprints are dealt out as pairs of tiles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import boxed, checkpoint, pick, slices, texts_as_bytes, unboxed
from framelake.llm.components import components

BITS = 64
#: Most differing bits of a link.
DISTANCE = 4
SHINGLE = 4
#: Fingerprints of one key that a task compares at once; more are dealt out as pairs of tiles of this size.
TILE = 2048
#: A fingerprint of more documents than this, and than one HOT_MOST-th of all, is salted in the last join: HOT_MOST are at most.
HOT_ROWS, HOT_MOST, SALTS = 1000, 10_000, 64


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The SimHash of one text: bits set in over half of the shingles' hashes; no words: zero."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= size:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1)
        first = np.concatenate(([0], ends[: n - size])).tolist()
        last = (ends[size - 1 :] - 1).tolist()
        hash_of = xxhash.xxh64_intdigest
        hashes = np.fromiter((hash_of(joined[a:b], 42) for a, b in zip(first, last, strict=True)), dtype=np.uint64, count=n - size + 1)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    on = np.flatnonzero(2 * counts > len(hashes))
    return sum(1 << int(i) for i in on)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a bigint) of every row."""

    def run(batches):
        for batch in slices(batches):
            got = [signed(fingerprint(t, size)) for t in texts_as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], names=["doc_id", "fp"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """How many blocks: the fewest (distance + 2 at least) whose keys leave under one stranger per fingerprint and key, 8 at most."""
    for blocks in range(distance + 2, distance + 4):
        if n <= 4 * 2 ** (BITS * (blocks - distance) // blocks):
            return blocks
    return distance + 4


def block_masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """The bits of every choice of blocks - distance blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, blocks - distance)]


def forest(left: np.ndarray, right: np.ndarray | None, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that join what is close among left (right None), or between left and right: a spanning forest of the close pairs."""
    every = left if right is None else np.concatenate([left, right])
    n, cut = len(every), len(left)
    label = np.arange(n)
    links = []
    for i in range(cut):
        rest = np.arange(i + 1, n) if right is None else np.arange(cut, n)
        rest = rest[label[rest] != label[i]]
        if not len(rest):
            continue
        near = rest[np.bitwise_count(every[rest] ^ every[i]) <= distance]
        if not len(near):
            continue
        groups, first = np.unique(label[near], return_index=True)
        links.extend((i, int(near[f])) for f in first)
        low = min(int(groups[0]), int(label[i]))
        label[np.isin(label, np.append(groups, label[i]))] = low
    return [(int(every[a].astype(np.int64)), int(every[b].astype(np.int64))) for a, b in links]


def close_links(prints: DataFrame, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """a, b: links whose components are those of all pairs of different fingerprints (``fp``) that differ in at most ``distance`` bits."""
    n = prints.count()
    masks = block_masks(blocks_for(n, distance), distance)
    keys = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)])
    keyed = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.m", "k.key")
    sizes = keyed.groupBy("m", "key").count().where("count > 1").select("m", "key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    dealt = keyed.join(sizes, ["m", "key"]).withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    dealt = dealt.select("fp", "m", "key", "t", F.explode(F.transform(every, lambda o: F.struct(F.least("t", o).alias("i"), F.greatest("t", o).alias("j")))).alias("p")).select("fp", "m", "key", "t", "p.i", "p.j")
    lists = dealt.groupBy("m", "key", "i", "j").agg(F.collect_list(F.when(F.col("t") == F.col("i"), F.col("fp"))).alias("left"), F.collect_list(F.when(F.col("t") != F.col("i"), F.col("fp"))).alias("right"))

    def run(batches):
        for batch in slices(batches, 4096):
            a, b = [], []
            for i, j, left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                left = np.sort(left.values.to_numpy(zero_copy_only=False)).view(np.uint64)
                right = np.sort(right.values.to_numpy(zero_copy_only=False)).view(np.uint64)
                if i == j and len(left) == 2:
                    found = [tuple(left.view(np.int64).tolist())] if int(left[0] ^ left[1]).bit_count() <= distance else []
                else:
                    found = forest(left, None if i == j else right, distance)
                a += [x for x, _ in found]
                b += [y for _, y in found]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return lists.select("i", "j", "left", "right").mapInArrow(run, "a bigint, b bigint")


def groups_of(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """nodes (fp, ...) with ``c``, the smallest fingerprint (as a bigint) that can be reached."""
    groups = components(close_links(nodes.select("fp"), distance))
    return checkpoint(nodes.join(groups, nodes["fp"] == groups["node"], "left").withColumn("c", F.coalesce("component", "fp")).drop("node", "component"))


def near_groups(docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row.

    component_id is the smallest doc_id that can be reached over links (rows with null doc_id take part and have a component too, null
    only where no reachable row has a doc_id). Texts without words have fingerprint zero and are linked like any other. Rows with equal
    fingerprints are one node from the start, so that copies, however many, are never paired; repeated rows are kept. An empty table gives an
    empty result; other columns are not read.
    """
    rows = checkpoint(fingerprints(docs, size))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    named = groups_of(nodes, distance)
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "c").select("fp", "component_id", "n")
    bar = max(HOT_ROWS, rows.count() // HOT_MOST)
    hot = labels.where(F.col("n") > bar).select("fp", F.lit(SALTS).alias("salts"))  # HOT_MOST rows at most
    salted = labels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > bar, SALTS - 1).otherwise(0))))
    dealt = rows.join(F.broadcast(hot), "fp", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.floor(F.rand(1) * SALTS)).cast("int"))
    out = dealt.join(salted, ["fp", "salt"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup_stage(docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE) -> DataFrame:
    """One row of each group of near copies, with the columns it came with: that of the smallest doc_id (nulls last; then the least hash of the text).

    Rows alike in doc_id and text count as one. Groups are settled among fingerprints, of which each row's is known by key; whole rows move once.
    """
    keys = {"kd": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)), "kh": F.xxhash64(F.col("text").cast("string"), F.col("doc_id").isNull())}

    def run(batches):
        for batch in slices(batches):
            got = [signed(fingerprint(t, size)) for t in texts_as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.int64())], names=["kd", "kh", "fp"])

    prints = docs.select(keys["kd"].alias("kd"), keys["kh"].alias("kh"), F.col("text").cast("string").alias("text")).mapInArrow(run, "kd bigint, kh bigint, fp bigint")
    nodes = checkpoint(prints.groupBy("fp").agg(F.min(F.struct("kd", "kh")).alias("first")))
    stay = groups_of(nodes, distance).groupBy("c").agg(F.min("first").alias("f")).select("f.kd", "f.kh")
    return unboxed(boxed(docs, **keys).join(stay, ["kd", "kh"], "left_semi").dropDuplicates(["kd", "kh"]), docs.columns)
