"""Connected components of an edge table by large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.session import cut_lineage


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is the smallest node.

    The two star steps alternate until the edges are stars and stay the same, in a number of
    rounds that grows with the logarithm of the longest path.  Each step's table is written to
    the shared checkpoint folder, and a node with very many edges is one row of a written table
    that skew handling can join in parts.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = cut_lineage(pairs.distinct(), "cc-edges")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        far = both.filter("v > u").join(cut_lineage(low, "cc-low"), "u")
        big = cut_lineage(far.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        low = cut_lineage(big.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        star = big.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(star.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = e.select(F.col("v").alias("node")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                roots.select("node", F.col("node").alias("root"))
            )
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
