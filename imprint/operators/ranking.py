"""Skew-safe row numbering.

``row_number() over (partition by g order by o)`` puts a whole group into one task; a group
holding a third of all rows then runs on one core.  Here rows are range-partitioned on the full
key ``(g, o)``, so a hot group is spread over many partitions, and numbered within each
(partition, group) by a window.  Only a partition's first group can go on from earlier
partitions, so one row per partition carries all the offsets; these few rows are broadcast.
NULL groups are groups like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imprint.session import cut_lineage

_LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | row index within partition


def number_rows(
    df: DataFrame,
    order: Sequence[str | Column],
    partition_by: Sequence[str] = (),
    out: str = "rn",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``out`` = 1-based position within ``partition_by`` groups by ``order``.

    ``order`` must make rows unique within a group for a deterministic answer.
    """
    keys = [F.col(c) for c in partition_by] + [F.col(c) if isinstance(c, str) else c for c in order]
    mid, pid, local = "_imprint_mid", "_imprint_pid", "_imprint_local"
    # without an explicit count AQE may merge neighbouring range partitions (order is kept)
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    placed = ranged.sortWithinPartitions(*keys).withColumn(mid, F.monotonically_increasing_id())
    placed = placed.withColumn(pid, F.shiftright(F.col(mid), _LOCAL_BITS))
    here = Window.partitionBy(pid, *partition_by).orderBy(mid)
    # two branches read the numbers (the offsets and the rows): write them once, so both see the
    # same ids even if a task is re-run, and so nested numberings keep a short lineage
    placed = cut_lineage(placed.withColumn(local, F.row_number().over(here).cast("long")), "numbered")

    group = F.struct(*(F.col(c) for c in partition_by), F.lit(0).alias("_one"))
    ends = placed.groupBy(pid).agg(
        F.min_by(group, F.col(mid)).alias("_first"),
        F.max_by(F.struct(group.alias("g"), F.col(local).alias("n")), F.col(mid)).alias("_last"),
    )
    # per group, in partition order: what earlier partitions end with of it (a partition's own
    # start is placed before its end)
    events = ends.select(pid, F.col("_first").alias("g"), F.lit(0).alias("_end"), F.lit(0).cast("long").alias("n"))
    events = events.unionByName(ends.select(pid, F.col("_last.g").alias("g"), F.lit(1).alias("_end"), F.col("_last.n").alias("n")))
    before = Window.partitionBy("g").orderBy(pid, "_end").rowsBetween(Window.unboundedPreceding, -1)
    events = events.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = events.where("_end = 0 and _before > 0").select(pid, F.col("g").alias("_first"), "_before")
    # at most one row per partition
    joined = placed.join(F.broadcast(starts.withColumnRenamed(pid, "_start")), F.col(pid) == F.col("_start"), "left")
    goes_on = group.eqNullSafe(F.col("_first"))
    number = F.col(local) + F.when(goes_on, F.col("_before")).otherwise(F.lit(0))
    return joined.withColumn(out, number.cast("long")).drop(mid, pid, local, "_start", "_first", "_before")
