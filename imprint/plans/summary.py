"""Plan summaries (A5-A9): status histogram, size totals and savings, run counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.functions.media import SIZED_STATUSES, STATUSES, human_size


def status_histogram(plan: DataFrame) -> DataFrame:
    """``(status, n, ord)`` - files per status, ``ord`` is the fixed listing order."""
    order = F.array_position(F.lit(STATUSES), F.col("status")).cast("int")
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("ord", order)


def size_totals(plan: DataFrame) -> DataFrame:
    """Totals over RENAMED, CONVERTED, COPIED and DRY_RUN rows, saved bytes and percent.

    Rows whose old or new size is unknown are counted in ``n_unknown`` and left out of the totals.
    ``saved_pct`` is NULL unless the original total is positive and the totals differ; a
    negative value means the files grew.
    """
    listed = F.col("status").isin(*SIZED_STATUSES)
    sized = listed & F.col("original_size").isNotNull() & F.col("new_size").isNotNull()
    t = plan.agg(
        F.count_if(listed & ~sized).cast("bigint").alias("n_unknown"),
        F.coalesce(F.sum(F.when(sized, F.col("original_size"))), F.lit(0)).cast("bigint").alias("total_original"),
        F.coalesce(F.sum(F.when(sized, F.col("new_size"))), F.lit(0)).cast("bigint").alias("total_new"),
    )
    saved = F.col("total_original") - F.col("total_new")
    pct = F.when(
        (F.col("total_original") > 0) & (saved != 0),
        F.round(saved.cast("double") / F.col("total_original").cast("double") * 100.0, 4),
    )
    return t.select(
        "total_original",
        "total_new",
        saved.alias("saved_bytes"),
        pct.alias("saved_pct"),
        human_size("total_original").alias("total_original_str"),
        human_size("total_new").alias("total_new_str"),
        human_size(saved).alias("saved_str"),
        "n_unknown",
    )
