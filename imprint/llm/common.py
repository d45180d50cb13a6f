"""Helpers shared by the operators: input columns, stage tables, positions without a global sort.

Inputs are projected to the columns an operator names before anything else is added, so extra
columns, whatever they are called, never clash with the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imprint.session import cut_lineage

ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back (cuts the lineage)."""
    return cut_lineage(df, f"llm-{label}")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def row_positions(df: DataFrame, label: str, out: str = "pos") -> DataFrame:
    """Stage ``df`` and add a gapless position 0..n-1 in the order it is stored.

    No shuffle: a row's place is its partition's offset plus its place in the partition.  The
    broadcast side has one row per partition.
    """
    t = stage(df.withColumn("_mid", F.monotonically_increasing_id()), label)
    part = F.shiftright("_mid", ROW_BITS)
    sizes = t.groupBy(part.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("_pid", F.coalesce(before, F.lit(0)).alias("_base"))
    t = t.withColumn("_pid", part).join(F.broadcast(base), "_pid")
    place = F.col("_mid").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return t.withColumn(out, F.col("_base") + place).drop("_pid", "_mid", "_base")


def positions_within(df: DataFrame, key: str, ties: Iterable[str], label: str, out: str) -> DataFrame:
    """Add a gapless position 0..m-1 within each value of ``key`` (few values, any size).

    Rows are range-partitioned on (key, ties), so one hot key spreads over many tasks; the
    broadcast table has a row per (partition, key) met, at most partitions + number of keys.
    ``ties`` should end in a unique column.
    """
    cols = [key, *ties]
    spread = df.repartitionByRange(partitions(df), *cols).sortWithinPartitions(*cols)
    t = stage(spread.withColumn("_mid", F.monotonically_increasing_id()), label)
    t = t.withColumn("_pid", F.shiftright("_mid", ROW_BITS))
    parts = t.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.withColumn("_base", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    t = t.join(F.broadcast(base), ["_pid", key])
    return t.withColumn(out, F.col("_base") + F.col("_mid") - F.col("_first")).drop("_pid", "_mid", "_base", "_first")
