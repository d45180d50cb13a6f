"""Long chains in large components, and pairs kept through changes of the index."""

import os
import random

import pytest

import imprint.operators.grouping as grouping
from imprint.operators.grouping import leader_seeds
from imprint.operators.hamming import similar_pairs
from imprint.operators.pair_delta import distinct_hashes, update_pairs
from imprint.plans.jobs import find_duplicates, refresh_index, refresh_pairs
from imprint.session import cut_lineage
from test_files import pattern, png_bytes

EDGES = "h_a long, h_b long, first_key_a long, first_key_b long"


def walk(edges):
    """Seeds by the sequential walk over keys (here the hash is the key)."""
    later = {}
    for a, b in edges:
        later.setdefault(min(a, b), []).append(max(a, b))
    covered, seeds = set(), set()
    for h in sorted({x for e in edges for x in e}):
        if h not in covered:
            seeds.add(h)
            covered.update(later.get(h, ()))
    return seeds


def seeds_of(spark, edges, **kw):
    df = spark.createDataFrame([(a, b, a, b) for a, b in edges], EDGES)
    return {r.h for r in leader_seeds(df, **kw).collect()}


def test_long_chain_with_a_dense_core(spark, monkeypatch):
    """50,000 links hang on a core: logarithmic rounds, equal to the walk."""
    rng = random.Random(1)
    core = [(a, b) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.4]
    chain = [(59, 1000)] + [(1000 + i, 1001 + i) for i in range(50_000)]
    edges = core + chain
    monkeypatch.setattr(grouping, "WALK_EDGES", 100)
    assert seeds_of(spark, edges, max_rounds=25) == walk(edges)


@pytest.mark.parametrize("seed", range(4))
def test_chain_rounds_equal_the_walk(spark, monkeypatch, seed):
    """Only rounds with jumps, on chains, trees, cycles, dense parts and shuffled keys."""
    monkeypatch.setattr(grouping, "PARALLEL_ROUNDS", 0)
    monkeypatch.setattr(grouping, "WALK_EDGES", -1)
    rng = random.Random(seed)
    names = list(range(400))
    rng.shuffle(names)
    edges = {(i, i + 1) for i in range(0, 150)} | {(150 + i // 2, 151 + i) for i in range(80)}
    edges |= {(240 + i, 240 + (i + 1) % 30) for i in range(30)}
    edges |= {tuple(rng.sample(range(280, 330), 2)) for _ in range(200)} | {(149, 290), (20, 250)}
    named = [(names[a], names[b]) for a, b in edges]
    assert seeds_of(spark, named) == walk(named)


def signed(u):
    return u - (1 << 64) if u >= 1 << 63 else u


def test_pairs_through_changes_equal_a_fresh_build(spark):
    rng = random.Random(6)
    centres = [rng.getrandbits(64) for _ in range(12)]

    def more(n):
        return {signed(rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))) for _ in range(n)}

    table = lambda hs: cut_lineage(spark.createDataFrame([(h,) for h in hs], "h long"), "test")
    state = more(150)
    before = table(state)
    pairs = cut_lineage(similar_pairs(before, 6, distinct_input=True), "test")
    for add, drop in ((40, 0), (0, 60), (30, 30), (0, 0), (0, 10**6), (50, 0)):
        gone = set(rng.sample(sorted(state), min(drop, len(state))))
        state = (state - gone) | more(add)
        now = table(state)
        pairs = cut_lineage(update_pairs(pairs, before, now, 6), "test")
        got = {tuple(r) for r in pairs.collect()}
        want = {(a, b, ((a ^ b) & (2**64 - 1)).bit_count()) for a in state for b in state if a < b}
        assert got == {x for x in want if x[2] <= 6} and pairs.count() == len(got)
        before = now


def test_small_changes_meet_few_candidates(spark):
    """The new hashes probe; the kept pairs are not joined again."""
    rng = random.Random(2)
    old = cut_lineage(spark.createDataFrame([(signed(rng.getrandbits(64)),) for _ in range(3000)], "h long"), "test")
    fresh = spark.createDataFrame([(signed(rng.getrandbits(64)),) for _ in range(5)], "h long")
    now = cut_lineage(old.unionByName(fresh), "test")
    import imprint.operators.pair_delta as delta

    seen = []
    plain = delta.similarity_join

    def watched(probe, *a, **kw):
        seen.append(probe.count())
        return plain(probe, *a, **kw)

    delta.similarity_join = watched
    try:
        update_pairs(similar_pairs(old, 4, distinct_input=True), old, now, 4).count()
        update_pairs(similar_pairs(old, 4, distinct_input=True), old, old, 4).count()
    finally:
        delta.similarity_join = plain
    assert seen == [5]


def test_job_keeps_pairs_with_the_index(spark, tmp_path):
    d, base = tmp_path / "in", str(tmp_path / "index")
    d.mkdir()
    for i in range(8):
        (d / f"p{i}.png").write_bytes(png_bytes(pattern(i // 2)))

    def listed(b):
        return [(r.group_no, r.distance, r.path) for r in find_duplicates(spark, str(d), b, threshold=5).collect()]

    assert len(listed(base)) == 8
    (d / "p8.png").write_bytes(png_bytes(pattern(3)))  # joins a group
    (d / "p0.png").unlink()  # leaves p1 alone
    (d / "p5.png").write_bytes(png_bytes(pattern(50)))
    os.utime(d / "p5.png", (1_500_000_000, 1_500_000_000))
    after = listed(base)
    assert after == listed(str(tmp_path / "fresh")) and len(after) == 5
    for f in (tmp_path / "index").glob("pairs-*/pairs/*.parquet"):  # lost pairs are built anew
        f.write_bytes(b"junk")
    for f in (tmp_path / "index").glob("pairs-*/pairs/.*.crc"):
        f.unlink()
    assert listed(base) == after
    index, _ = refresh_index(spark, str(d), base)
    assert refresh_pairs(spark, index, base, 5).count() == similar_pairs(distinct_hashes(index), 5).count()
