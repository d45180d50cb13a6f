"""k nearest hashes for a table of queries (T2 for a batch; F3).

Multi-index hashing answers "within T" exactly, so the k nearest are found by raising T: the queries
that have ``k`` files within T leave, and the others go on with a larger T.  What a query has
within T is all there is within T, so nothing nearer can be missed.  The thresholds are the
largest ones whose band plan costs at most the shares ROUNDS of comparing the queries with
everything, so queries in dense places leave cheaply and a round that would not pay is not run.  Queries
that are left are far from almost everything, where no banding tells hashes apart: they are compared
with all hashes in bounded blocks, each block keeping only what can be among a query's ``k``
nearest.

Hashes are searched once, whatever number of files or queries has them.  Files are taken up from
the nearest hashes only, at most ``k`` of a hash (row limits are applied before the shuffle).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imprint._ship import ship_with_tasks
from imprint.operators.hamming import (
    CANDIDATE_COST,
    N_BITS,
    PROBE_COST,
    BandPlan,
    choose_band_plan,
    hash_sample,
    sampled_distances,
    similarity_join,
)
from imprint.session import cut_lineage

ship_with_tasks(__name__)

ROUNDS = (1 / 64, 1 / 16, 1 / 4)  # cost of a round against comparing the queries with everything
QUERY_BLOCK, HASH_BLOCK = 1 << 14, 1 << 20  # most rows of a block of either side
LEAST_BLOCK = 1 << 10  # query blocks are not made smaller than this to occupy more tasks


def thresholds(sample: np.ndarray, n_queries: int, n_hashes: int, beyond: int) -> list[tuple[int, BandPlan]]:
    """Rising thresholds above ``beyond``, with their plans: the largest one within each cost of ROUNDS."""
    differ = sampled_distances(sample)
    everything = float(n_queries) * n_hashes
    best: dict[float, tuple[int, BandPlan]] = {}
    for t in range(max(beyond + 1, 0), N_BITS if everything else 0):
        plan = choose_band_plan(t, n_queries, n_hashes, sample)
        met = zip(plan.masks, plan.radii, strict=True)
        near = sum(float((np.bitwise_count(differ & np.uint64(m)) <= r).mean()) for m, r in met) if len(differ) else 1.0
        rows = n_queries * plan.keys_per_row + n_hashes * plan.bands
        cost = PROBE_COST * rows + CANDIDATE_COST * near * everything
        if cost > ROUNDS[-1] * everything:
            break
        for share in ROUNDS:
            if cost <= share * everything:
                best[share] = t, plan
    return sorted({t: (t, plan) for t, plan in best.values()}.values(), key=lambda x: x[0])


def _near_in_block(k: int, beyond: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        q = left.column("hq").to_numpy().view(np.uint64)
        h, n = right.column("h").to_numpy(), right.column("n_files").to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        bits = h.view(np.uint64)
        # of the hashes at one distance, those with the smallest first keys hold the first files
        place = np.asarray(pc.rank(right.column("first"), "ascending", null_placement="at_start", tiebreaker="first"))
        for x in q:
            far = np.bitwise_count(bits ^ x).astype(np.int64)
            files = np.bincount(far, weights=n, minlength=N_BITS + 1)
            files[: beyond + 1] = 0
            reach = np.searchsorted(files.cumsum(), min(k, files.sum()))
            last = np.flatnonzero((far == reach) & (far > beyond))
            if len(last) > k:
                last = last[np.argpartition(place[last], k - 1)[:k]]
            at = np.concatenate((np.flatnonzero((far > beyond) & (far < reach)), last))
            out[0].append(np.full(len(at), x).view(np.int64))
            out[1].append(h[at])
            out[2].append(far[at])
        hq, near, far = (np.concatenate(c) if c else np.empty(0, np.int64) for c in out)
        return pa.table({"hq": hq, "h": near, "n_files": _taken(h, n, near), "distance": far.astype(np.int32)})

    return search


def _taken(h: np.ndarray, n: np.ndarray, near: np.ndarray) -> np.ndarray:
    order = np.argsort(h)
    return n[order][np.searchsorted(h[order], near)] if len(near) else np.empty(0, np.int64)


def _all_blocks(queries: DataFrame, hashes: DataFrame, n_queries: int, n_hashes: int, k: int, beyond: int) -> DataFrame:
    """(hq, h, n_files, distance): what each block of hashes has among a query's ``k`` nearest."""
    size, nh = QUERY_BLOCK, -(-n_hashes // HASH_BLOCK)
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while size > LEAST_BLOCK and -(-n_queries // size) * nh < tasks:
        size //= 2
    nq = -(-n_queries // size)
    q = queries.select("hq", F.pmod(F.xxhash64("hq"), F.lit(nq)).alias("i"))
    q = q.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nh - 1))))
    x = hashes.select("h", "n_files", "first", F.pmod(F.xxhash64("h"), F.lit(nh)).alias("hj"))
    x = x.withColumn("hi", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    pairs = q.groupBy(F.col("i").cast("long"), F.col("j").cast("long")).cogroup(
        x.groupBy(F.col("hi").cast("long"), F.col("hj").cast("long"))
    )
    return pairs.applyInArrow(_near_in_block(k, beyond), "hq long, h long, n_files long, distance int")


def nearest_join(
    queries: DataFrame,
    files: DataFrame,
    k: int = 10,
    beyond: int = -1,
    query_key: str = "query_id",
    key: str = "id",
    hash_col: str = "h",
) -> DataFrame:
    """(query_key, rank, key, distance): for every query the ``k`` files of the smallest distance
    above ``beyond``, ties by ``key``.

    ``queries`` has (query_key, hash_col), ``files`` (key, hash_col).  With ``beyond`` >= 0 a
    query's own file and its duplicates are not among the results.  Rows without a hash have no
    part; a query gets fewer than ``k`` rows only if fewer files are beyond.
    """
    # fingerprints are costly and both tables are read several times: write the narrow ones once
    files = files.select(F.col(key).alias("key"), F.col(hash_col).alias("h")).where("h is not null")
    files = cut_lineage(files, "nearest-files")
    asked = queries.select(F.col(query_key).alias("query"), F.col(hash_col).alias("hq")).where("hq is not null")
    asked = cut_lineage(asked, "nearest-asked")
    hashes = files.groupBy("h").agg(F.count(F.lit(1)).alias("n_files"), F.min("key").alias("first"))
    hashes = cut_lineage(hashes, "nearest-hashes")
    left = cut_lineage(asked.select("hq").distinct(), "nearest-queries")
    n_hashes, n_left, found = hashes.count(), left.count(), []
    sample = hash_sample(hashes)
    for t, plan in thresholds(sample, n_left, n_hashes, beyond):
        if not n_left:
            break
        near = similarity_join(
            left, hashes.drop("first"), t, "hq", "h", plan=plan, n_probe=n_left, n_index=n_hashes, sample=sample
        )
        near = near.where(F.col("distance") > beyond).select("hq", "h", "n_files", "distance")
        near = cut_lineage(near, "nearest-pairs")
        done = near.groupBy("hq").agg(F.sum("n_files").alias("n")).where(F.col("n") >= k).select("hq")
        found.append(near.join(done, "hq", "left_semi"))
        left = cut_lineage(left.join(done, "hq", "left_anti"), "nearest-left")
        n_left = left.count()
    if n_left and n_hashes:
        found.append(_all_blocks(left, hashes, n_left, n_hashes, k, beyond))
    if not found:
        found = [left.limit(0).select("hq", F.col("hq").alias("h"), F.lit(0).cast("long").alias("n_files"), F.lit(0).alias("distance"))]
    near = reduce(DataFrame.unionByName, found)

    # hashes that fewer than k files are strictly nearer than
    nearer = Window.partitionBy("hq").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("nearer", F.coalesce(F.sum("n_files").over(nearer), F.lit(0)))
    near = cut_lineage(near.where(F.col("nearer") < k).select("hq", "h", "distance"), "nearest-kept")
    first = F.row_number().over(Window.partitionBy("h").orderBy("key"))
    few = files.join(near.select("h").distinct(), "h", "left_semi").withColumn("n", first).where(F.col("n") <= k)
    hits = near.join(few.select("h", "key"), "h").select("hq", "key", "distance")
    rank = F.row_number().over(Window.partitionBy("hq").orderBy("distance", "key"))
    hits = hits.withColumn("rank", rank).where(F.col("rank") <= k)
    out = asked.join(hits, "hq")
    return out.select(F.col("query").alias(query_key), "rank", F.col("key").alias(key), F.col("distance").cast("int").alias("distance"))
