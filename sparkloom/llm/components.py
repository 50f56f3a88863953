"""Connected components of an edge table, by alternating star contraction.

Each round is two joins and two aggregations on the edges that are left; the
driver only learns whether the round changed anything. Hot nodes meet in
shuffled joins, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.scratch import Scratch


def _toward_least(both: DataFrame, larger_only: bool) -> DataFrame:
    """For each node a with neighbours b: links the b (all, or the larger ones) to the least of them and a."""
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = both.join(least, "a")
    if larger_only:
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    kept = linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, component) for every node that an edge (a, b) names; component is the least node reachable.

    Loops, repeated and null-ended edges are ignored. No edges: no rows. Works for any ordered node type.
    """
    kept = edges.select("a", "b").where("a <> b")
    now = scratch.put(kept.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}-0")
    turn, before = 0, None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = scratch.put(_toward_least(both, True), f"{tag}-{turn}l")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        turn += 1
        now = scratch.put(_toward_least(down, False), f"{tag}-{turn}")
        scratch.drop(f"{tag}-{turn - 1}", f"{tag}-{turn - 1}l")
        # stars: no node is both a child and a parent, and no child has two parents
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == before:
            break
        before = (state["n"], state["h"])
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
