"""Connected components by alternating large-star and small-star steps, each a join on per-vertex minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over directed edges (a > b). Minima are aggregated per task first and written, so that the join of a
    hot vertex's edges with its minimum is one whose skewed side Spark can split."""
    both = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "minima")
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return staged(out.where("a <> b").distinct(), "star")


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every vertex of an edge; component is the smallest id that is reachable.

    Self-loops and nulls are ignored, so a vertex with no other edge is missing from the result. Only two counts
    come to the driver each round.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b"))
    now, before = staged(pairs.distinct(), "edges"), None
    for _ in range(most_rounds):
        now = _star(_star(now, True), False)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    # Stars: every edge leads to its component's smallest id.
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
