"""Skew-safe numbering equals row_number(), also when one group holds a third of all rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from imprint.operators.ranking import number_rows


def test_number_rows_matches_row_number_with_hot_group(spark):
    rng = random.Random(12)
    rows = [("hot" if i % 3 == 0 else f"g{rng.randint(0, 40)}", rng.random(), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, id long")
    got = {r.id: r.rn for r in number_rows(df, ["v", "id"], partition_by=["g"], num_partitions=16).collect()}
    want = {
        r.id: r.rn
        for r in df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("v", "id"))).collect()
    }
    assert got == want


def test_number_rows_global(spark):
    df = spark.range(0, 5000).withColumn("k", (F.col("id") * 7919) % 5003)
    got = {r.id: r.rn for r in number_rows(df, ["k", "id"], out="rn", num_partitions=8).collect()}
    ordered = sorted(((r.k, r.id) for r in df.collect()))
    assert got == {i: n + 1 for n, (_, i) in enumerate(ordered)}
