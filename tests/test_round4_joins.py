"""Radii shared by both sides, joins by blocks, and groups found without all pairs."""

import random

import numpy as np
import pytest

import imprint.operators.hamming as hm
from imprint.operators.hamming import BandPlan, band_plan, choose_band_plan, similar_pairs, similarity_join

LONG = "h long"


def signed(u):
    u &= (1 << 64) - 1
    return u - (1 << 64) if u >= 1 << 63 else u


def far(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def hashes(seed, t, n=150):
    rng = random.Random(seed)
    centres = [0, 2**64 - 1, 1 << 63, *(rng.getrandbits(64) for _ in range(4))]
    near = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, t))) for c in centres for _ in range(12)]
    return sorted({signed(h) for h in [*centres, *near, *(rng.getrandbits(64) for _ in range(n))]})


def brute(hs, t):
    return {(a, b, far(a, b)) for i, a in enumerate(hs) for b in hs[i + 1 :] if far(a, b) <= t}


@pytest.mark.parametrize(("t", "m", "hot"), [(8, 3, False), (8, 2, False), (13, 2, True), (5, 1, True)])
def test_shared_radii_meet_each_pair_once(spark, monkeypatch, t, m, hot):
    """Also in the sign bit, with bits flipped on both sides, and through hot keys."""
    if hot:
        monkeypatch.setattr(hm, "HOT_KEY_MIN_ROWS", 5)
    whole = band_plan(t, m)
    low = [sum(1 << b for b in hm._bits_of(x)[-12:]) for x in whole.masks]  # narrow bands: many meetings
    plan = BandPlan(tuple(min(r, 12) for r in whole.radii), tuple(low), whole.entropy, tuple(min(r, 12) // 2 for r in whole.radii))
    if m == 1:
        plan = BandPlan((5,), (sum(1 << b for b in range(52, 64)),), (12.0,), (2,))
    hs = hashes(t, t)
    df = spark.createDataFrame([(h,) for h in hs], LONG)
    got = [tuple(r) for r in similar_pairs(df, t, plan=plan, split_hot_keys=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(hs, t)


def test_shared_radii_make_few_rows():
    sample = np.random.default_rng(3).integers(0, 2**64, 512, dtype=np.uint64)
    for n in (50_000, 500_000, 3_000_000):
        plan = choose_band_plan(8, n, n, sample, share=True)
        assert plan.reach >= 8 and plan.keys_per_row + plan.index_keys < 200
        assert not hm._blocks_pay(plan, n, n, sample)
        wide = choose_band_plan(22, n, n, sample, share=True)
        assert hm._blocks_pay(wide, n, n, sample)


@pytest.mark.parametrize("t", [0, 9, 22, 64])
def test_blocks_equal_brute_force(spark, monkeypatch, t):
    monkeypatch.setattr(hm, "BLOCKS_FROM", 0)
    monkeypatch.setattr(hm, "_blocks_pay", lambda *a: True)
    monkeypatch.setattr(hm, "LEAST_BLOCK", 16)
    monkeypatch.setattr(hm, "BLOCK", 64)
    hs = hashes(t, 12)
    rows = [(h, f"k{i}" if i % 5 else None) for i, h in enumerate(hs)]
    df = spark.createDataFrame(rows, "h long, key string")
    got = [tuple(r) for r in similar_pairs(df, t, distinct_input=True, carry="key").collect()]
    key = dict(rows)
    assert len(got) == len(brute(hs, t))
    assert set(got) == {(a, b, d, key[a], key[b]) for a, b, d in brute(hs, t)}

    probe = spark.createDataFrame([(i, h) for i, h in enumerate(hs[:40])] * 2 + [(-1, None)], "q long, hq long")
    met = similarity_join(probe, spark.createDataFrame([*rows, (None, "x")], "h long, key string"), t, "hq", "h")
    want = [(i, h, x, key[x], far(h, x)) for i, h in enumerate(hs[:40]) for x in hs if far(h, x) <= t]
    name = lambda r: (r[0], r[1], r[2], r[3] or "", r[4])
    assert sorted(map(name, map(tuple, met.collect()))) == sorted(map(name, want * 2))
    assert met.columns == ["q", "hq", "h", "key", "distance"]


def walked(files, t):
    """Groups by the sequential walk: (group, seed, key, hash, distance)."""
    by = {}
    for key, h in files:
        by.setdefault(h, []).append(key)
    order = sorted(by, key=lambda h: (min(by[h]), h))
    covered, out, no = set(), set(), 0
    for s in order:
        if s in covered:
            continue
        ball = [h for h in order if far(s, h) <= t]
        if len(ball) > 1 or len(by[s]) > 1:
            no += 1
            covered.update(ball)
            out |= {(no, s, key, h, far(s, h)) for h in ball for key in by[h]}
    return out


@pytest.mark.parametrize(("t", "sparse"), [(22, False), (22, True), (5, True)])
def test_dense_groups_without_all_pairs(spark, monkeypatch, t, sparse):
    """Several blocks, and what is left by its pairs; equal to the walk over all hashes."""
    import imprint.operators.grouping as grouping

    monkeypatch.setattr(grouping, "WALK_BLOCK", 20)
    dense = [True, *[not sparse] * 1000]
    monkeypatch.setattr(grouping, "_dense", lambda *a: dense.pop(0))
    made = []
    plain = grouping.similar_pairs
    monkeypatch.setattr(grouping, "similar_pairs", lambda h, *a, **kw: made.append(h.count()) or plain(h, *a, **kw))
    hs = hashes(t, 6)
    files = [(f"f{i % 97}-{i}", h) for i, h in enumerate(hs)] + [(f"c{i}", h) for i, h in enumerate(hs[::9])]
    df = spark.createDataFrame(files, "path string, h long")
    rows = [tuple(r) for r in grouping.duplicate_groups(df, t, key_col="path").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == walked(files, t)
    assert bool(made) == sparse and all(n <= len(hs) for n in made)


def test_density_is_seen_on_a_sample(spark):
    import imprint.operators.grouping as grouping

    rng = random.Random(3)
    df = spark.createDataFrame([(signed(rng.getrandbits(64)),) for _ in range(600)], LONG)
    assert grouping._dense(df, 26) and not grouping._dense(df, 5)


def test_fingerprints_hold_few_tokens():
    """Texts of ever new tokens: what a task remembers stays small, nulls and blanks are kept."""
    import hashlib
    import tracemalloc

    import pyarrow as pa

    from imprint.operators import fingerprint as fpr

    texts = [None, b"", b" \t\r\n", *(b" ".join(b"w%d-%d" % (i, j) for j in range(1000)) for i in range(300))]
    batches = [pa.array(texts[i : i + 50], pa.binary()) for i in range(0, len(texts), 50)]
    tracemalloc.start()
    got = [h for out in fpr._simhash_udf.func(iter(batches)) for h in out.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32e6
    digests = [hashlib.md5(w).digest()[:8] for w in texts[7].split(b" ")]
    assert got[:3] == [None, 0, 0] and got[7] == fpr.simhash_numpy(b"".join(digests)) and len(got) == len(texts)
