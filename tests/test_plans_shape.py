"""Physical-plan checks: pruning reaches the scan, the Hamming join is an equi-join."""

import random

from imprint.operators.hamming import similar_pairs
from imprint.sources.listing import list_images


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_listing_never_reads_contents(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    plan = _plan(list_images(spark, str(tmp_path)))
    assert "content" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_hamming_join_has_no_nested_loop(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.getrandbits(63),) for _ in range(300)], "h long")
    plan = _plan(similar_pairs(df, 5))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "HashJoin" in plan or "SortMergeJoin" in plan
