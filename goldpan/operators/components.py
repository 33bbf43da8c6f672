"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldpan.scratch import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is joined to the least of the node and its neighbours."""
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is joined to the least of them. Here a > b."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    near = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch | None = None, max_rounds: int = 60) -> DataFrame:
    """(a, b) edges over any orderable id -> (node, component), component the least reachable node.

    Nodes without an edge aren't in the result. Every round is a few shuffles of what edges are
    left, and each node keeps at most the edges it had: a star of any size stays linear. Rounds
    grow with the logarithm of the longest path. Each round is a table in the shared folder.
    Null ends and self-loops are left out.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.table(e, "edges")
    # What a round leaves alone: the number of edges and a sum of their hashes.
    digest = (F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = e.agg(*digest).first()
    if not before[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        after_table = scratch.table(_small_star(_large_star(e)), "round")
        after = after_table.agg(*digest).first()
        scratch.drop(e)
        e, done, before = after_table, tuple(after) == tuple(before), after
        if done:
            stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
