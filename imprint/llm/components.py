"""Connected components of an edge table, by alternating star steps written round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.llm.common import stage


def components(edges: DataFrame, label: str, max_rounds: int = 80) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b); the root is the smallest node.

    A large step links every larger neighbour of a node to the smallest node it knows, a small
    step does so for the smaller ones, so paths halve and rounds grow with the logarithm of the
    longest path.  Smallest neighbours are aggregated with map-side combine and written, like the
    edges of each step, so that the joins meet two written tables and skew handling can split a node
    with very many edges.
    Loops, repeated edges and an empty table are allowed.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    e = stage(e, f"{label}-edges")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = stage(low, f"{label}-low")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), f"{label}-large")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), f"{label}-low")
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{label}-small")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
