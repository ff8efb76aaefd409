"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm._common import cut

MAX_ROUNDS = 60


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a > b). Large: neighbours above a node move to its smallest neighbour; small: those below."""
    near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of edges (a, b), the smallest node of its component.

    Null ends and loops are ignored; nodes without an edge to another node have no row. Rounds grow with the logarithm
    of the longest path; each is written to the shared folder. A hub's edges are joined, not gathered.
    """
    found = cut(edges.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        found = cut(_starred(_starred(found, True), False))
        seen = found.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        mark = seen
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
