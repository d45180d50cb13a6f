"""Brute-force equality for the banded Hamming join (J5) and the greedy grouping (G1)."""

import random

import pytest

from imprint.operators.grouping import duplicate_groups
import numpy as np

from imprint.operators.hamming import band_plan, choose_band_plan, range_search, similar_pairs
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def signed(u):
    u &= MASK
    return u - (1 << 64) if u >= 1 << 63 else u


def dist(a, b):
    return bin((a ^ b) & MASK).count("1")


def brute_pairs(hashes, t):
    hs = sorted(set(hashes))
    return {(a, b, dist(a, b)) for i, a in enumerate(hs) for b in hs[i + 1:] if dist(a, b) <= t}


def sequential_groups(files, t):
    """The reference walk: hashes in order of first key; a hash not covered seeds a ball."""
    by_hash = {}
    for key, h in files:
        by_hash.setdefault(h, []).append(key)
    order = sorted(by_hash, key=lambda h: (min(by_hash[h]), h))
    covered, groups = set(), []
    for h in order:
        if h in covered:
            continue
        ball = [(o, dist(h, o)) for o in order if dist(h, o) <= t]
        if len(ball) > 1 or len(by_hash[h]) > 1:
            groups.append((h, ball))
            covered.update(o for o, _ in ball)
    out = set()
    for no, (seed, ball) in enumerate(groups, 1):
        for o, d in ball:
            for key in by_hash[o]:
                out.add((no, seed, key, o, d))
    return out


def _flip(h, bits):
    for b in bits:
        h ^= 1 << b
    return signed(h)


def adversarial(t):
    rng = random.Random(7)
    base = [0, -1, signed(1 << 63), signed(rng.getrandbits(64))]
    hs = list(base)
    a = signed(rng.getrandbits(64))
    b = _flip(a, range(t)) if t else a
    c = _flip(b, range(t, 2 * t)) if t else a
    hs += [a, b, c]  # chain: d(a,b) = d(b,c) = t, d(a,c) = 2t
    for _ in range(3):  # overlapping balls around random centres
        centre = signed(rng.getrandbits(64))
        hs += [_flip(centre, rng.sample(range(64), rng.randint(0, max(t, 1)))) for _ in range(6)]
    return hs


@pytest.mark.parametrize("t", [0, 1, 5, 16])
def test_pairs_match_brute_force(spark, t):
    rng = random.Random(t)
    hs = adversarial(t) + [signed(rng.getrandbits(64)) for _ in range(300)]
    df = spark.createDataFrame([(h,) for h in hs], "h long")
    got = {tuple(r) for r in similar_pairs(df, t).collect()}
    assert got == brute_pairs(hs, t)


def test_pairs_every_band_plan(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    hs = [_flip(centre, rng.sample(range(64), rng.randint(0, 12))) for _ in range(120)]
    df = spark.createDataFrame([(h,) for h in hs], "h long")
    want = brute_pairs(hs, 10)
    for m in (4, 5, 6, 11):
        got = {tuple(r) for r in similar_pairs(df, 10, plan=band_plan(10, m), split_hot_keys=False).collect()}
        assert got == want, m


def test_pairs_all_pairs_threshold_64(spark):
    rng = random.Random(5)
    hs = [signed(rng.getrandbits(64)) for _ in range(40)] + [0, -1]
    df = spark.createDataFrame([(h,) for h in hs], "h long")
    assert {tuple(r) for r in similar_pairs(df, 64).collect()} == brute_pairs(hs, 64)


@pytest.mark.parametrize("t", [0, 3, 6, 12])
def test_hot_keys_are_rebanded(spark, monkeypatch, t):
    import imprint.operators.hamming as hm

    monkeypatch.setattr(hm, "HOT_KEY_MIN_ROWS", 5)
    rng = random.Random(9 + t)
    hs = [signed(rng.getrandbits(20)) for _ in range(80)]  # high bands all zero: hot keys
    centre = rng.getrandbits(20)
    hs += [_flip(centre, rng.sample(range(20), rng.randint(0, 4))) for _ in range(30)]  # near copies
    hs += [signed(rng.getrandbits(64)) for _ in range(40)]
    df = spark.createDataFrame([(h,) for h in hs], "h long")
    assert {tuple(r) for r in similar_pairs(df, t).collect()} == brute_pairs(hs, t)


def test_band_plan_choice():
    assert choose_band_plan(0, 1000, 1000).bands == 1
    p = choose_band_plan(5, 10**6, 10**6)
    assert p.reach >= 5 and sum(p.widths) <= 64


@pytest.mark.parametrize("t", [0, 1, 3, 5, 8, 13, 20, 33, 63, 64])
def test_band_plans_miss_no_pair(t):
    """Every plan is exact: at distance t some band is within its radius, wherever the bits are."""
    rng = random.Random(t)
    skewed = np.array([rng.getrandbits(64) & rng.getrandbits(64) & 0xFFFF0000FFFF | 1 << 40 for _ in range(300)], np.uint64)
    for n in (10, 10**4, 10**9):
        for sample in (None, skewed, skewed[:1]):
            p = choose_band_plan(t, n, n, sample)
            assert p.reach >= t and p.keys_per_row <= 4096
            for _ in range(30):
                x = sum(1 << b for b in rng.sample(range(64), t))
                assert any((x & m).bit_count() <= r for m, r in zip(p.masks, p.radii, strict=True))


def test_measured_radii_beat_equal_ones():
    """On skewed and correlated bits, the chosen plan meets fewer pairs per key than equal radii."""
    rng = np.random.default_rng(4)
    hs = rng.integers(0, 2**64, 2500, dtype=np.uint64) & rng.integers(0, 2**64, 2500, dtype=np.uint64)
    # few ones, and the low byte repeats the next one
    hs = hs & ~np.uint64(0xFF) | hs >> np.uint64(8) & np.uint64(0xFF)
    i, j = np.triu_indices(len(hs), 1)
    differ = hs[i] ^ hs[j]

    def cost(p):
        met = sum(int((np.bitwise_count(differ & np.uint64(m)) <= r).sum()) for m, r in zip(p.masks, p.radii, strict=True))
        return len(hs) * (p.keys_per_row + p.bands) + 2 * met

    for t in (5, 8, 14):
        equal = [q for m in range(1, t + 2) if (q := band_plan(t, m)).keys_per_row <= 4096]
        assert cost(choose_band_plan(t, len(hs), len(hs), hs[:512])) <= 1.2 * min(map(cost, equal))


def test_range_search(spark):
    rng = random.Random(11)
    hs = [signed(rng.getrandbits(64)) for _ in range(200)]
    q = hs[0]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hs)], "id int, h long")
    got = {(r.id, r.distance) for r in range_search(df, F.lit(q), 30).collect()}
    assert got == {(i, dist(h, q)) for i, h in enumerate(hs) if dist(h, q) <= 30}


@pytest.mark.parametrize("t", [0, 1, 5, 16])
def test_groups_match_sequential_walk(spark, t):
    rng = random.Random(100 + t)
    hs = adversarial(t) + [signed(rng.getrandbits(64)) for _ in range(60)]
    files = [(f"f{i:04d}", h) for i, h in enumerate(hs)]
    files += [(f"g{i:04d}", h) for i, h in enumerate(hs[:5])]  # exact copies
    df = spark.createDataFrame(files, "path string, h long")
    got = {tuple(r) for r in duplicate_groups(df, t, key_col="path").collect()}
    assert got == sequential_groups(files, t)


def test_group_properties(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    hs = [_flip(centre, rng.sample(range(64), rng.randint(0, 8))) for _ in range(80)]
    files = [(i, h) for i, h in enumerate(hs)]
    df = spark.createDataFrame(files, "id long, h long")
    rows = duplicate_groups(df, 5).collect()
    seeds = {r.seed_h for r in rows}
    assert all(r.distance <= 5 and r.distance == dist(r.seed_h, r.h) for r in rows)
    assert all(dist(a, b) > 5 for a in seeds for b in seeds if a != b)
    assert {tuple(r) for r in rows} == sequential_groups(files, 5)
