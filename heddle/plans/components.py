"""Connected components by alternating large-star and small-star rounds
(Kiveris et al., 2014): O(log^2 n) rounds, and the edge table never grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from heddle.plans.stored import drop_table, written

MAX_ROUNDS = 60


def _watched(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` written, with their number and a checksum taken in the same pass."""
    seen = Observation()
    out = written(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
    return out, (seen.get["n"], seen.get["sum"])


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of ``edges``
    that has an edge to another node.  Edges to itself, repeats and nulls are ignored.

    Only a row count and a checksum of the edges reach the driver."""
    a, b = F.col(left), F.col(right)
    e, before = _watched(edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        # large star: larger neighbours move to the smallest of the neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself move to the smallest neighbour
        near = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        moved = large.join(near, F.col("u") == F.col("k")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old = e
        e, after = _watched(moved.unionByName(near.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        drop_table(old)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
