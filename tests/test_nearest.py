"""The batch k-nearest join against brute force: ties, copies, far queries, few files."""

import random

import pytest
from pyspark.sql import functions as F

import imprint.operators.nearest as nearest
from imprint.operators.nearest import nearest_join, thresholds


def signed(u):
    return u - (1 << 64) if u >= 1 << 63 else u


def brute(queries, files, k, beyond):
    out = set()
    for q, hq in queries:
        if hq is None:
            continue
        far = sorted(((hq ^ h) & (2**64 - 1)).bit_count() * 10**9 + i for i, h in files if h is not None)
        far = [(x // 10**9, x % 10**9) for x in far if x // 10**9 > beyond]
        out |= {(q, n, i, d) for n, (d, i) in enumerate(far[:k], 1)}
    return out


def near_and_far(seed, n):
    """Clusters of near copies, repeated hashes, strangers, and a missing hash."""
    rng = random.Random(seed)
    hs = []
    for _ in range(n // 10):
        c = rng.getrandbits(64)
        hs += [signed(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9)))) for _ in range(8)]
        hs += [signed(c)] * 2
    hs += [signed(rng.getrandbits(64)) for _ in range(n // 5)] + [None, 0, -1]
    return list(enumerate(hs))


@pytest.mark.parametrize("k,beyond", [(1, -1), (5, -1), (10, 5), (40, 12), (10**6, 30), (3, 64)])
def test_nearest_equals_brute_force(spark, k, beyond):
    files = near_and_far(k, 300)
    queries = [f for f in files if f[0] % 7 == 0] + [(10**6, signed(0xF0F0F0F0F0F0F0F0)), (10**6 + 1, None), (10**6 + 2, files[0][1])]
    q = spark.createDataFrame(queries, "query_id long, h long")
    f = spark.createDataFrame(files, "id long, h long").withColumn("distance", F.lit("clash"))
    got = nearest_join(q, f, k, beyond)
    assert got.columns == ["query_id", "rank", "id", "distance"]
    assert {tuple(r) for r in got.collect()} == brute(queries, files, k, beyond)


def test_rounds_and_blocks_agree(spark, monkeypatch):
    """Rounds only, one round and then blocks, blocks only."""
    files = near_and_far(4, 400)
    queries = [f for f in files if f[0] % 5 == 0]
    q, f = spark.createDataFrame(queries, "query_id long, h long"), spark.createDataFrame(files, "id long, h long")
    want = brute(queries, files, 6, 2)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 37)
    monkeypatch.setattr(nearest, "HASH_BLOCK", 53)
    monkeypatch.setattr(nearest, "LEAST_BLOCK", 9)
    plan = nearest.choose_band_plan
    for steps in ((4, 9, 20, 30, 63), (8,), ()):
        monkeypatch.setattr(nearest, "thresholds", lambda s, nq, n, beyond: [(t, plan(t, nq, n, s)) for t in steps])  # noqa: B023
        assert {tuple(r) for r in nearest_join(q, f, 6, 2).collect()} == want


def test_thresholds_rise_and_pay():
    import numpy as np

    sample = np.random.default_rng(0).integers(0, 2**64, 512, dtype=np.uint64)
    steps = [t for t, _ in thresholds(sample, 10**6, 2 * 10**7, 5)]
    assert len(steps) >= 2 and steps == sorted(set(steps)) and steps[0] > 5
    assert all(p.reach >= t for t, p in thresholds(sample, 10**6, 2 * 10**7, 5))
    assert thresholds(sample, 10, 100, 5) == [] and thresholds(sample[:0], 0, 0, 5) == []
    dense = np.repeat(sample[:8], 64)  # all hashes near: no banding pays
    assert thresholds(dense, 10**6, 10**7, 5) == []


def test_many_files_at_one_distance(spark):
    """Ties go by key, and a block returns few of them."""
    files = [(i, signed(1 << (i % 64))) for i in range(500)]  # all at distance 1 from zero
    q = spark.createDataFrame([(1, 0)], "query_id long, h long")
    f = spark.createDataFrame([(str(i), h) for i, h in files], "id string, h long")
    want = sorted(str(i) for i, _ in files)[:7]
    assert [r.id for r in nearest_join(q, f, 7, 0).orderBy("rank").collect()] == want


def test_nearest_empty_inputs(spark):
    q, f = spark.createDataFrame([], "query_id long, h long"), spark.createDataFrame([(1, 5)], "id long, h long")
    assert nearest_join(q, f).count() == 0
    assert nearest_join(f.withColumnRenamed("id", "query_id"), q.withColumnRenamed("query_id", "id")).count() == 0


def test_no_cross_join_in_plan(spark, sf_dir):
    from imprint.queries import registry

    plan = registry()["closest10_docs"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
