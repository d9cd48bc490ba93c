"""Connected components of an undirected graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import checkpoint

#: Rounds after which it gives up; each at least halves what is left, so that this is never reached.
MAX_ROUNDS = 60


def _state(links: DataFrame) -> tuple:
    """What tells two sets of links apart: their number and the exclusive or of their hashes."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame, kind: str = "bigint") -> DataFrame:
    """node, component (the smallest node that can be reached) for every node of ``edges`` (a, b).

    Loops and repeated edges do no harm; null ends are left out. A round joins nothing: it groups by node, takes the least
    neighbour with a map-side partial aggregate and links the others to it, so that a hub's neighbours are joined to one value only.
    """
    links = edges.select(F.greatest("a", "b").cast(kind).alias("v"), F.least("a", "b").cast(kind).alias("u")).where("v != u").distinct()
    links = checkpoint(links)
    state = _state(links)
    if not state[0]:
        return links.select(F.col("v").alias("node"), F.col("u").alias("component"))
    for _ in range(MAX_ROUNDS):
        both = links.select("v", "u").union(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("n")).select("v", F.least("v", "n").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v != u").distinct()
        near = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(near, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").where("v != u").distinct()
        new = checkpoint(small)
        before, state, links = state, _state(new), new
        if state == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    return links.groupBy("v").agg(F.min("u").alias("u")).select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(links.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
