"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a table of prime size, given by an offset and a step from the digest of its name. In turns each shard
claims the first slot of its permutation that is still free, until the table is full: shards get as many slots as the others, give or take one, and few
slots change hands when a shard comes or goes. The table's size is a parameter, so that broadcasting it is bounded by it; placing a document is one
lookup. Only the key's digest counts: a hot source or text is spread over all shards.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i:03d}" for i in range(32))
SLOTS = 4099


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest(), 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard (its index) of every slot."""
    if not is_prime(slots) or slots < len(shards) or not shards or len(set(shards)) < len(shards):
        raise ValueError("the table needs a prime size, and a slot for each of at least one differently named shards")
    at = [_digest(f"offset/{s}") % slots for s in shards]
    step = [_digest(f"step/{s}") % (slots - 1) + 1 for s in shards] if slots > 2 else [1] * len(shards)
    table, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def slot(key: Column, slots: int) -> Column:
    """The slot of a key: 52 bits of the MD5 of its text, modulo the table's size; null is a key like any other."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 13)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def placements(docs: DataFrame, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """doc_id, slot, shard for every row.

    Null doc_ids share a slot; repeated rows go where their doc_id goes; an empty table gives an empty result; other columns are not read. The
    table (``slots`` rows) is broadcast: nothing else moves.
    """
    filled = ",".join(map(str, fill(shards, slots)))
    names = F.array(*[F.lit(s) for s in shards])
    spark = docs.sparkSession
    table = spark.range(1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("slot", "i")).select("slot", F.element_at(names, F.col("i").cast("int") + 1).alias("shard"))
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id")).withColumn("slot", slot(F.col("doc_id"), slots))
    return rows.join(F.broadcast(table), "slot").select("doc_id", "slot", "shard")


def placements_sql(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> str:
    """The same in SQL, with the table written out."""
    filled = ",".join(map(str, fill(shards, slots)))
    names = ",".join(f"'{s}'" for s in shards)
    return f"""
WITH keyed AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT % {slots} AS INTEGER) AS slot
  FROM documents)
SELECT doc_id, slot, list_extract([{names}], list_extract([{filled}], slot + 1) + 1) AS shard FROM keyed"""
