"""Incremental fingerprint index.

The index is a table ``(path, mtime, h)``.  A new listing ``(path, mtime)`` is reconciled with it
in one full outer join on ``path`` (one shuffle): a path only in the listing is *new*, one in
both with a different mtime is *changed*, equal mtime is *unchanged*, only in the index is
*deleted* (membership in the listing decides, not a probe of the file system).  Only new and
changed files are decoded and hashed; the next index is the unchanged rows plus the fresh
hashes, so it always equals a fresh build over the current listing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reconciliation actions.
ACTIONS = ["new", "changed", "unchanged", "deleted"]


def index_changes(
    listing: DataFrame, index: DataFrame, path: str = "path", mtime: str = "mtime", carry: str | None = None
) -> DataFrame:
    """``(path, mtime, old_mtime, action)`` for every path of the listing or the index.

    mtimes are compared for equality only, never ordered; of a repeated path the latest counts
    (U1).  ``carry`` names an index column that comes along as ``old_{carry}``, so that the next
    index needs no second join.  An index that is bucketed by path is not shuffled.
    """
    cur = listing.groupBy(F.col(path).alias("path")).agg(F.max(mtime).alias("mtime"), F.lit(True).alias("_in_cur"))
    old_cols = [F.max(mtime).alias("old_mtime"), F.lit(True).alias("_in_old")]
    if carry:
        old_cols.append(F.max_by(carry, F.coalesce(F.col(mtime), F.lit("0001-01-01").cast("timestamp_ntz"))).alias(f"old_{carry}"))
    old = index.groupBy(F.col(path).alias("path")).agg(*old_cols)
    j = cur.join(old, "path", "full_outer")
    in_cur, in_old = F.col("_in_cur").isNotNull(), F.col("_in_old").isNotNull()
    action = (
        F.when(in_cur & ~in_old, "new")
        .when(~in_cur & in_old, "deleted")
        .when(F.col("mtime").eqNullSafe(F.col("old_mtime")), "unchanged")
        .otherwise("changed")
    )
    return j.select("path", "mtime", "old_mtime", action.alias("action"), *([f"old_{carry}"] if carry else []))


def to_hash(changes: DataFrame) -> DataFrame:
    """Paths to decode and hash - new or changed."""
    return changes.where(F.col("action").isin("new", "changed")).select("path", "mtime")


def update_index(index: DataFrame, changes: DataFrame, hashed: DataFrame) -> DataFrame:
    """Unchanged rows of the old index plus freshly hashed rows that succeeded.

    ``hashed`` is ``(path, mtime, h, ok)``; failed rows (``ok`` false) are left out, so a file
    that cannot be decoded is retried on the next run.  Changes that carry ``old_h`` hold the
    unchanged rows already, and the index is not read again.
    """
    same = changes.where(F.col("action") == "unchanged")
    if "old_h" in changes.columns:
        kept = same.select("path", "mtime", F.col("old_h").alias("h"))
    else:
        kept = index.join(same.select("path"), "path", "left_semi").select("path", "mtime", "h")
    fresh = hashed.where(F.col("ok")).select("path", "mtime", "h").dropDuplicates(["path"])
    return kept.unionByName(fresh)


def action_counts() -> list[Column]:
    """A5: aggregates of the number of new, changed, unchanged and deleted files."""
    return [F.count_if(F.col("action") == a).cast("bigint").alias(f"n_{a}") for a in ACTIONS]


def failures() -> Column:
    """A5: aggregate of the number of files that could not be decoded."""
    return F.count_if(~F.col("ok")).cast("bigint").alias("n_failed")


def run_counts(changes: DataFrame) -> DataFrame:
    """A5: one row with the number of new, changed, unchanged and deleted files."""
    return changes.agg(*action_counts())


def failed_count(hashed: DataFrame) -> DataFrame:
    """A5: files that could not be decoded in this run."""
    return hashed.agg(failures())
