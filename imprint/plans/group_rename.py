"""Group-prefix rename plan and its undo.

Both are plans: a row per file with the name it would get and an outcome; nothing is moved.

* Rename: every file of a duplicate group, in the given directory and not already prefixed,
  gets ``group-NN-<name>``.  A file in several (overlapping) groups is renamed by the first
  group; later groups report ``error`` because the file has moved.  A target present in the
  directory snapshot is a ``conflict``.  Targets are unique per file and prefixed files never
  move, so this set-based test equals a sequential one.
* Undo: every ``group-*`` file gets its prefix stripped once; an unparsable prefix is an
  ``error``; a target present in the snapshot, or claimed by an earlier file in listing order,
  is a ``conflict``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.functions.naming import (
    GROUP_PREFIX,
    basename,
    dirname,
    group_prefixed,
    local_path,
    strip_group_prefix,
)
from imprint.operators.ranking import number_rows


def rename_plan(groups: DataFrame, directory: str, existing: DataFrame, path_col: str = "path") -> DataFrame:
    """``(group_no, path, name, new_name, outcome)``; outcome renamed / conflict / error /
    skipped_prefixed / skipped_elsewhere.

    ``groups`` has ``group_no`` and ``path_col``; ``existing`` has ``name`` (directory snapshot).
    """
    base_dir = local_path(F.lit(directory))  # F4 with both folders in one spelling
    g = groups.select("group_no", F.col(path_col).alias("path")).distinct()
    g = g.withColumn("name", basename("path")).withColumn("_dir", local_path(dirname("path")))
    g = g.withColumn("new_name", group_prefixed("name", "group_no"))
    taken = existing.select(F.col("name").alias("new_name")).distinct().withColumn("_taken", F.lit(True))
    g = g.join(taken, "new_name", "left")
    movable = (F.col("_dir") == base_dir) & ~F.col("name").startswith(GROUP_PREFIX)
    # The first group (in group order) whose target is free moves the file
    winner = (
        g.where(movable & F.col("_taken").isNull()).groupBy("path").agg(F.min("group_no").alias("_winner"))
    )
    g = g.join(winner, "path", "left")
    outcome = (
        F.when(F.col("_dir") != base_dir, "skipped_elsewhere")
        .when(F.col("name").startswith(GROUP_PREFIX), "skipped_prefixed")
        .when(F.col("_taken").isNotNull(), "conflict")
        .when(F.col("group_no") != F.col("_winner"), "error")
        .otherwise("renamed")
    )
    return g.select("group_no", "path", "name", "new_name", outcome.alias("outcome"))


def undo_plan(listing: DataFrame, key: str = "name", is_file: str | None = None) -> DataFrame:
    """``(key, name, new_name, outcome)`` for every ``group-*`` entry of a directory listing.

    ``listing`` has ``name`` (and a unique ``key`` for listing order ties); directories
    (``is_file`` false) are skipped.
    """
    lst = listing
    if is_file is not None:
        lst = lst.where(F.col(is_file))
    cand = lst.where(F.col("name").startswith(GROUP_PREFIX)).withColumn("new_name", strip_group_prefix("name"))
    taken = listing.select(F.col("name").alias("new_name")).distinct().withColumn("_taken", F.lit(True))
    cand = cand.join(taken, "new_name", "left")
    ok = cand.where(F.col("new_name").isNotNull() & F.col("_taken").isNull())
    sel = ["name", "new_name"] if key == "name" else [key, "name", "new_name"]
    order = ["name"] if key == "name" else ["name", key]
    ranked = number_rows(ok.select(*sel), order, partition_by=["new_name"], out="_rank").select(key, "_rank")
    cand = cand.join(ranked, key, "left")
    outcome = (
        F.when(F.col("new_name").isNull(), "error")
        .when(F.col("_taken").isNotNull(), "conflict")
        .when(F.col("_rank") > 1, "conflict")  # W4: first in listing order wins
        .otherwise("renamed")
    )
    cols = [key] if key != "name" else []
    return cand.select(*cols, "name", "new_name", outcome.alias("outcome"))


def outcome_counts(plan: DataFrame) -> DataFrame:
    """Files per outcome."""
    return plan.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
