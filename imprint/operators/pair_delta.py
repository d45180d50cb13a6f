"""Similar pairs of a changing set of hashes: only what is new is joined (J5 on J3).

The pairs of an earlier state and its distinct hashes are kept as tables.  Hashes that have gone
take their pairs with them (two anti-joins); pairs that come in have a new hash on at least one side, so
the new hashes probe all hashes in one similarity join whose candidates grow with the change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.operators.hamming import hash_sample, similar_pairs, similarity_join
from imprint.session import cut_lineage


def distinct_hashes(files: DataFrame, hash_col: str = "h") -> DataFrame:
    return files.select(F.col(hash_col).alias("h")).where(F.col("h").isNotNull()).distinct()


def first_pairs(hashes: DataFrame, threshold: int) -> DataFrame:
    """All pairs (h_a, h_b, distance) of a written table of distinct hashes."""
    return similar_pairs(hashes, threshold, distinct_input=True)


def update_pairs(pairs: DataFrame, before: DataFrame, now: DataFrame, threshold: int) -> DataFrame:
    """Pairs (h_a, h_b, distance), h_a < h_b, of the hashes ``now``, from those of the hashes ``before``.

    ``before`` and ``now`` are written tables of distinct, non-null hashes ``h``; ``pairs`` are the
    pairs of ``before`` within the same threshold.
    """
    fresh = cut_lineage(now.join(before, "h", "left_anti"), "delta-fresh")
    gone = cut_lineage(before.join(now, "h", "left_anti"), "delta-gone")
    kept = pairs.select("h_a", "h_b", "distance")
    for side in ("h_a", "h_b"):
        kept = kept.join(gone.select(F.col("h").alias(side)), side, "left_anti")
    n_fresh = fresh.count()
    if not n_fresh:
        return kept.select("h_a", "h_b", "distance")
    marked = cut_lineage(now.join(fresh.withColumn("new", F.lit(True)), "h", "left").select(
        F.col("h").alias("h_i"), F.coalesce("new", F.lit(False)).alias("new")
    ), "delta-marked")
    sample = hash_sample(marked, "h_i")
    met = similarity_join(
        fresh.select(F.col("h").alias("h_p")), marked, threshold, "h_p", "h_i",
        n_probe=n_fresh, n_index=marked.count(), sample=sample,
    )
    # a pair of two new hashes is met from either side
    met = met.where((F.col("h_p") < F.col("h_i")) | (~F.col("new") & (F.col("h_p") != F.col("h_i"))))
    added = met.select(F.least("h_p", "h_i").alias("h_a"), F.greatest("h_p", "h_i").alias("h_b"), "distance")
    return kept.select("h_a", "h_b", "distance").unionByName(added)
