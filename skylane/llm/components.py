"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest node among u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them; edges go from the larger to the smaller node."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select("u", F.col("least").alias("v"))).distinct()


def connected_components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b), component being the smallest node reachable.

    Any orderable node type will do. Loops and repeated edges are harmless; edges with a null end are left out, and no
    edges give no rows. Groups are only ever reduced by min and distinct, both combined before the shuffle, and joins
    on a hot node are split by adaptive execution. The edge list is written to the shared folder after each round, and
    the one before it deleted. Rounds grow with the logarithm of the longest path; after ``limit`` of them, which no
    input of realistic size needs, a RuntimeError is raised.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = stage(e, "edges"), None
    for _ in range(limit):
        state = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if not state.n or (state.n, state.h) == before:
            break
        before = (state.n, state.h)
        old, e = e, stage(_small_star(_large_star(e)), "edges")
        unstage(old)
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())
