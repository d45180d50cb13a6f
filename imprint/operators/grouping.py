"""Greedy near-duplicate groups (G1a-G1d, J6, A1, A2, A4).

Semantics: walk the distinct hashes in order (ascending first file key, then hash); a hash not
yet covered is a *seed* and its group is its whole ball - every hash within the threshold,
each reported with its distance to the seed.  A ball with more than one hash, or one hash with
more than one file, is a group; its hashes become covered.  Balls are not reduced by earlier
groups, so groups may overlap; members may be up to twice the threshold apart.

The seeds are the lexicographically first maximal independent set of the threshold graph.
Spark computes them with the parallel fix-point of Blelloch, Fineman & Shun (SPAA 2012):
each round, every undecided hash with no undecided earlier neighbour becomes a seed and its
later neighbours become covered; decided hashes and their edges leave the working set.  After a
few rounds the small components that are left are walked one task each, and in larger ones chains
are settled by pointer jumping: a hash with one undecided earlier neighbour is a seed exactly if
that neighbour is not, so along a chain of such hashes the parity of the distance to its start
decides, however long it is.  Each round is a few
equi-joins on the shrinking edge table; its state is written to the shared
checkpoint folder so the lineage stays one round deep, and one emptiness test per round is the
only thing the driver sees.

Where hashes have very many neighbours, all pairs would be a fixed share of the square of the hashes,
and most of them join covered hashes.  There the walk goes in blocks: one task walks the first
undecided hashes, a bounded block, and its seeds are joined with all hashes.  That gives their balls
and decides every hash in them, so a few blocks leave little, and no other pair is ever made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint._ship import ship_with_tasks
from imprint.operators.components import components
from imprint.operators.hamming import BandPlan, hash_sample, sampled_distances, similar_pairs, similarity_join
from imprint.operators.ranking import number_rows
from imprint.session import cut_lineage

ship_with_tasks(__name__)

PARALLEL_ROUNDS = 4
WALK_EDGES = 20_000  # most edges of a component that one task walks
WALK_BLOCK = 1 << 14  # hashes of a block that one task walks
DENSE = 4  # neighbours that a hash has in such a block, from which on hashes are walked in blocks


def hash_table(files: DataFrame, key_col: str = "id", hash_col: str = "h") -> DataFrame:
    """A2: one row per distinct hash with its first file key and file count (map-side combine)."""
    return (
        files.where(F.col(hash_col).isNotNull())
        .groupBy(F.col(hash_col).alias("h"))
        .agg(F.min(key_col).alias("first_key"), F.count(F.lit(1)).alias("n_files"))
    )


def exact_duplicates(files: DataFrame, key_col: str = "id", hash_col: str = "h") -> DataFrame:
    """A2: hashes shared by more than one file."""
    return hash_table(files, key_col, hash_col).where(F.col("n_files") > 1)


def hash_stats(files: DataFrame, hash_col: str = "h") -> DataFrame:
    """A1: number of files and of distinct hashes ("tree size")."""
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct(hash_col).alias("n_hashes"))


def _orient(pairs: DataFrame) -> DataFrame:
    """Direct every edge from the earlier hash to the later one (order: first_key, h)."""
    a = F.struct(F.col("first_key_a").alias("k"), F.col("h_a").alias("h"))
    b = F.struct(F.col("first_key_b").alias("k"), F.col("h_b").alias("h"))
    e = pairs.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
    return e.select(F.col("src.h").alias("src"), F.col("dst.h").alias("dst"), F.col("src.k").alias("k_src"), F.col("dst.k").alias("k_dst"))


def _walk(edges: pd.DataFrame) -> pd.DataFrame:
    """The seeds of one small component, by the sequential walk itself."""
    keys = dict(zip(edges["src"], edges["k_src"])) | dict(zip(edges["dst"], edges["k_dst"]))
    later: dict[int, list[int]] = {}
    for a, b in zip(edges["src"], edges["dst"]):
        later.setdefault(a, []).append(b)
    covered: set[int] = set()
    seeds = []
    for h in sorted(keys, key=lambda h: (keys[h], h)):
        if h not in covered:
            seeds.append(h)
            covered.update(later.get(h, ()))
    return pd.DataFrame({"h": np.array(seeds, dtype=np.int64)})


def _chain_round(active: DataFrame, undecided: DataFrame) -> DataFrame:
    """Seeds of one round with pointer jumping: hashes without an undecided earlier neighbour, and
    of the hashes that hang on such a one by a chain of single earlier neighbours those at an even
    distance.  Jumps double, so a chain takes the logarithm of its length."""
    sources = undecided.join(active.select(F.col("dst").alias("h")), "h", "left_anti")
    sources = cut_lineage(sources, "g1-sources")
    single = active.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("up")).where(F.col("n") == 1)
    chain = cut_lineage(single.select(F.col("dst").alias("h"), "up", F.lit(True).alias("odd")), "g1-chain")
    moved = True
    while moved:
        above = chain.select(F.col("h").alias("up"), F.col("up").alias("far"), F.col("odd").alias("also"))
        step = chain.join(above, "up", "left").select(
            "h",
            F.coalesce("far", "up").alias("up"),
            (F.col("odd") != F.coalesce("also", F.lit(False))).alias("odd"),
            F.col("far").isNotNull().alias("moved"),
        )
        step = cut_lineage(step, "g1-chain")
        moved = not step.where("moved").isEmpty()
        chain = step.drop("moved")
    even = chain.where("not odd").join(sources.select(F.col("h").alias("up")), "up", "left_semi").select("h")
    return sources.unionByName(even)


def leader_seeds(pairs: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Seeds among hashes that have at least one edge, as a one-column ``(h)`` table.

    ``pairs`` carries ``first_key_a`` and ``first_key_b``.  Most edges are settled in the first
    few parallel rounds.  What is left then are chains (burst pictures), which take a round per
    two links; so the components of the rest that have at most WALK_EDGES edges are each walked
    in one task, and larger ones go on in rounds that jump along chains until no edge is left.
    ``max_rounds`` raises when hit.
    """
    active = cut_lineage(_orient(pairs), "g1-edges")
    undecided = cut_lineage(
        active.select(F.col("src").alias("h")).union(active.select(F.col("dst").alias("h"))).distinct(), "g1-nodes"
    )
    seeds = None
    rounds = 0
    while not active.isEmpty():
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"grouping did not converge in {max_rounds} rounds")
        if rounds == PARALLEL_ROUNDS + 1:
            of = components(active.select(F.col("src").alias("a"), F.col("dst").alias("b")))
            of = active.join(cut_lineage(of.withColumnRenamed("node", "src"), "g1-parts"), "src")
            sizes = of.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= WALK_EDGES)
            small = cut_lineage(of.join(cut_lineage(sizes.select("root"), "g1-small"), "root"), "g1-walk")
            new_seeds = cut_lineage(small.groupBy("root").applyInPandas(_walk, "h long"), "g1-seeds")
            decided = small.select(F.col("src").alias("h")).union(small.select(F.col("dst").alias("h"))).distinct()
        else:
            if rounds > PARALLEL_ROUNDS:
                new_seeds = cut_lineage(_chain_round(active, undecided), "g1-seeds")
            else:
                new_seeds = undecided.join(active.select(F.col("dst").alias("h")), "h", "left_anti")
                new_seeds = cut_lineage(new_seeds, "g1-seeds")
            covered = active.join(new_seeds.select(F.col("h").alias("src")), "src", "left_semi")
            decided = new_seeds.unionByName(covered.select(F.col("dst").alias("h")))
        next_active = active.join(decided.select(F.col("h").alias("src")), "src", "left_anti").join(
            decided.select(F.col("h").alias("dst")), "dst", "left_anti"
        )
        seeds = new_seeds if seeds is None else seeds.unionByName(new_seeds)
        active = cut_lineage(next_active, "g1-edges")
        undecided = cut_lineage(undecided.join(decided, "h", "left_anti"), "g1-nodes")
    # with no edge left, every remaining undecided hash has no undecided earlier neighbour
    return undecided if seeds is None else seeds.unionByName(undecided)


def _walk_block(threshold: int):
    def walk(block: pa.Table) -> pa.Table:
        order = np.argsort(block.column("place").to_numpy())
        h = block.column("h").to_numpy()[order].view(np.uint64)
        seeds = []
        while len(h):
            seeds.append(h[0])
            h = h[np.bitwise_count(h ^ h[0]) > threshold]
        return pa.table({"h": np.array(seeds, np.uint64).view(np.int64)})

    return walk


def _dense(hashes: DataFrame, threshold: int) -> bool:
    """Whether a block of these hashes decides many others, by a bounded sample of them."""
    differ = sampled_distances(hash_sample(hashes))
    return bool(len(differ)) and float((np.bitwise_count(differ) <= threshold).mean()) * WALK_BLOCK >= DENSE


def _balls_by_blocks(nodes: DataFrame, threshold: int, n_nodes: int) -> DataFrame:
    """(seed_h, h, distance): the ball of every seed, itself included, found block by block.

    When what is left is no longer dense, its seeds are found from its pairs."""
    undecided, n_left, balls = nodes.select("h", "first_key"), n_nodes, None
    sample = hash_sample(nodes)
    while n_left:
        if n_left <= WALK_BLOCK or _dense(undecided, threshold):
            placed = number_rows(undecided, ["first_key", "h"], out="place")
            first = placed.where(F.col("place") <= WALK_BLOCK).select("h", "place")
            seeds = first.groupBy(F.lit(0).alias("block")).applyInArrow(_walk_block(threshold), "h long")
        else:
            found = cut_lineage(similar_pairs(undecided, threshold, distinct_input=True, carry="first_key"), "g1-pairs")
            paired = found.select(F.col("h_a").alias("h")).union(found.select(F.col("h_b").alias("h")))
            seeds = leader_seeds(found).unionByName(undecided.select("h").join(paired, "h", "left_anti"))
        seeds = cut_lineage(seeds.select(F.col("h").alias("seed_h")), "g1-seeds")
        ball = similarity_join(
            seeds, nodes.select("h"), threshold, "seed_h", "h", n_probe=seeds.count(), n_index=n_nodes, sample=sample
        )
        ball = cut_lineage(ball.select("seed_h", "h", "distance"), "g1-balls")
        balls = ball if balls is None else balls.unionByName(ball)
        undecided = cut_lineage(undecided.join(ball.select("h").distinct(), "h", "left_anti"), "g1-nodes")
        n_left = undecided.count()
    return balls


def duplicate_groups(
    files: DataFrame,
    threshold: int = 5,
    key_col: str = "id",
    hash_col: str = "h",
    plan: BandPlan | None = None,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """G1: ``(group_no, seed_h, <key_col>, h, distance)`` - one row per file per group it is in.

    ``group_no`` counts from 1 in seed order; files of a hash in two balls appear in both groups.
    ``pairs`` (h_a, h_b, distance) are the pairs of the files' distinct hashes within the
    threshold, where they are known already.
    """
    # fingerprints are costly (decode, hashing) and read twice below: write the narrow table once
    files = cut_lineage(
        files.select(F.col(key_col).alias("_key"), F.col(hash_col).alias("h")).where(F.col("h").isNotNull()), "g1-files"
    )
    nodes = cut_lineage(hash_table(files, "_key", "h"), "g1-hashes")
    if pairs is None and plan is None and _dense(nodes, threshold):
        balls = _balls_by_blocks(nodes, threshold, nodes.count())
        copied = nodes.where(F.col("n_files") > 1).select(F.col("h").alias("seed_h"))
        copied = balls.where("h = seed_h").select("seed_h").join(copied, "seed_h", "left_semi")
        many = balls.where("h <> seed_h").select("seed_h").unionByName(copied).distinct()
        group_seeds = many.join(nodes.select(F.col("h").alias("seed_h"), "first_key"), "seed_h")
        numbered = number_rows(group_seeds, ["first_key", "seed_h"], out="group_no").select("seed_h", "group_no")
        ball = balls.join(numbered, "seed_h").select("group_no", "seed_h", "h", "distance")
        return _ball_files(ball, files, key_col)
    if pairs is None:
        found = similar_pairs(nodes, threshold, "h", plan=plan, distinct_input=True, carry="first_key")  # G1a
    else:
        first = nodes.select("h", "first_key")
        found = pairs.select("h_a", "h_b", "distance")
        for side in "ab":
            found = found.join(first.toDF(f"h_{side}", f"first_key_{side}"), f"h_{side}")
    found = cut_lineage(found, "g1-pairs")
    seeds = leader_seeds(found)
    pairs = found.select("h_a", "h_b", "distance")
    lonely = nodes.where(F.col("n_files") > 1).select("h").join(seeds, "h", "left_anti").join(
        pairs.select(F.col("h_a").alias("h")).union(pairs.select(F.col("h_b").alias("h"))), "h", "left_anti"
    )
    group_seeds = seeds.unionByName(lonely).join(nodes, "h").select(F.col("h").alias("seed_h"), "first_key")
    numbered = number_rows(group_seeds, ["first_key", "seed_h"], out="group_no").select("seed_h", "group_no")
    # The ball of each seed - itself plus every neighbour in either direction
    ball = (
        numbered.select("group_no", "seed_h", F.col("seed_h").alias("h"), F.lit(0).alias("distance"))
        .unionByName(
            numbered.join(pairs.withColumnRenamed("h_a", "seed_h"), "seed_h").select(
                "group_no", "seed_h", F.col("h_b").alias("h"), "distance"
            )
        )
        .unionByName(
            numbered.join(pairs.withColumnRenamed("h_b", "seed_h"), "seed_h").select(
                "group_no", "seed_h", F.col("h_a").alias("h"), "distance"
            )
        )
    )
    return _ball_files(ball, files, key_col)


def _ball_files(ball: DataFrame, files: DataFrame, key_col: str) -> DataFrame:
    # Hash -> files; a hash shared by very many files is split by AQE's skew join
    return ball.join(files, "h").select("group_no", "seed_h", F.col("_key").alias(key_col), "h", "distance")


def group_sizes(groups: DataFrame, key_col: str = "id") -> DataFrame:
    """A4: files and distinct hashes per group."""
    return groups.groupBy("group_no").agg(
        F.count(F.lit(1)).alias("n_files"), F.countDistinct("h").alias("n_hashes")
    )


def group_listing(groups: DataFrame, key_col: str = "id") -> DataFrame:
    """Groups in listing order - group number, then distance to the seed, then file key.

    A global sort is a presentation step; plans and counts use the unordered table.
    """
    return groups.orderBy("group_no", "distance", key_col)
