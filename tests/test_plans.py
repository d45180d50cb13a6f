"""Organise plan (W1/W2 uniqueness, keep rule), index reconciliation, rename/undo round trip."""

import datetime as dt

from pyspark.sql import functions as F

from imprint.operators.index import index_changes, run_counts, to_hash, update_index
from imprint.plans.group_rename import rename_plan, undo_plan
from imprint.plans.organise import OrganiseOptions, next_free_names, organise_plan
from imprint.sources.index_store import read_index, write_index

LISTING = "path string, name string, size_bytes long, width long, height long, encoded_size long, mtime timestamp_ntz"


def _listing(spark, rows):
    return spark.createDataFrame(rows, LISTING)


def test_w1_w2_unique_and_free(spark):
    t = dt.datetime(2024, 1, 1, 10, 0, 0)
    rows = []
    for i in range(30):  # same capture second for everyone: one hot target
        rows.append((f"p{i:02d}", f"20240101_100000_{i:02d}.jpg" if i % 3 else "x.jpg", 2000, 10, 10, 1000, t))
    rows.append(("q1", "20240101_100000_001.jpg", 2000, 10, 10, 1000, t))  # natural clash with a counter name
    listing = _listing(spark, rows)
    taken = spark.createDataFrame([("20240101_100000.jpg",), ("20240101_100000_002.jpg",)], "name string")
    plan = organise_plan(
        listing, OrganiseOptions(rename=True, date_format="%Y%m%d_%H%M%S"), taken=taken, key="path"
    ).collect()
    moved = [r.new_filename for r in plan if r.status == "RENAMED"]
    assert len(moved) == len(set(moved))
    assert not set(moved) & {"20240101_100000.jpg", "20240101_100000_002.jpg"}
    assert not set(moved) & {r[1] for r in rows}  # names present at the start count as taken


def test_next_free_names_matches_sequential(spark):
    import random

    rng = random.Random(4)
    claims = [(i, rng.choice(["a.jpg", "a_001.jpg", "b.png", "a_002.jpg"]), f"n{i:03d}") for i in range(40)]
    taken = ["a.jpg", "a_003.jpg", "b_001.png"]
    df = spark.createDataFrame(claims, "key long, target string, name string")
    got = dict(next_free_names(df, spark.createDataFrame([(t,) for t in taken], "name string"), "key").collect())
    assert len(set(got.values())) == len(got)
    assert not set(got.values()) & set(taken)
    reserved = set(taken) | {c[1] for c in claims}
    for key, target, _ in claims:  # every name is target or target_NNN, never someone else's claim
        stem, ext = target.rsplit(".", 1)
        assert got[key] == target or (got[key].startswith(stem + "_") and got[key].endswith("." + ext))
        if got[key] != target:
            assert got[key] not in reserved or got[key] == target


def test_keep_original_at_ten_percent(spark):
    rows = [
        ("a", "a.jpg", 1000, 100, 100, 900, None),  # exactly 10 % smaller: not < 10 %, converted
        ("b", "b.jpg", 1000, 100, 100, 901, None),  # 9.9 %: keep a copy
        ("c", "c.png", 1000, 100, 100, 500, None),  # format changes: converted
        ("d", "d.jpg", 1000, -1, -1, None, None),  # undecodable: error
    ]
    plan = organise_plan(_listing(spark, rows), OrganiseOptions(convert=True, target_format="jpg"), key="path")
    got = {r.path: (r.status, r.new_size) for r in plan.collect()}
    assert got == {"a": ("CONVERTED", 900), "b": ("COPIED", 1000), "c": ("CONVERTED", 500), "d": ("ERROR", 1000)}


def test_index_update_equals_fresh_build(spark):
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    old = spark.createDataFrame([("a", t0, 1), ("b", t0, 2), ("c", t0, 3)], "path string, mtime timestamp_ntz, h long")
    listing = spark.createDataFrame([("a", t0), ("b", t1), ("d", t1)], "path string, mtime timestamp_ntz")
    ch = index_changes(listing, old)
    acts = {r.path: r.action for r in ch.collect()}
    assert acts == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "new"}
    assert tuple(run_counts(ch).first()) == (1, 1, 1, 1)
    hashed = to_hash(ch).withColumn("h", F.when(F.col("path") == "b", 20).otherwise(40)).withColumn("ok", F.lit(True))
    new = {tuple(r) for r in update_index(old, ch, hashed).collect()}
    assert new == {("a", t0, 1), ("b", t1, 20), ("d", t1, 40)}


def test_index_store_versions(spark, tmp_path):
    base = str(tmp_path / "index")
    assert read_index(spark, base).count() == 0
    t0 = dt.datetime(2024, 1, 1)
    idx = spark.createDataFrame([("a", t0, 1)], "path string, mtime timestamp_ntz, h long")
    assert write_index(idx, base) == 1
    assert write_index(idx.where("false"), base) == 2  # a deletions-only run is persisted too
    assert read_index(spark, base).count() == 0
    assert read_index(spark, base, hash_func="dhash").count() == 0


def test_rename_then_undo_round_trip(spark):
    groups = spark.createDataFrame(
        [(1, "dir/a.jpg"), (1, "dir/b.jpg"), (2, "dir/b.jpg"), (2, "dir/c.jpg"), (3, "other/d.jpg"), (3, "dir/group-5-e.jpg")],
        "group_no long, path string",
    )
    existing = spark.createDataFrame([(n,) for n in ["a.jpg", "b.jpg", "c.jpg", "group-5-e.jpg", "group-02-c.jpg"]], "name string")
    plan = {(r.group_no, r.path): (r.new_name, r.outcome) for r in rename_plan(groups, "dir/", existing).collect()}
    assert plan[(1, "dir/a.jpg")] == ("group-01-a.jpg", "renamed")
    assert plan[(1, "dir/b.jpg")] == ("group-01-b.jpg", "renamed")
    assert plan[(2, "dir/b.jpg")][1] == "error"  # already moved by group 1
    assert plan[(2, "dir/c.jpg")][1] == "conflict"
    assert plan[(3, "other/d.jpg")][1] == "skipped_elsewhere"
    assert plan[(3, "dir/group-5-e.jpg")][1] == "skipped_prefixed"
    after = {"group-01-a.jpg", "group-01-b.jpg", "c.jpg", "group-5-e.jpg", "group-02-c.jpg"}
    listing = spark.createDataFrame([(n,) for n in sorted(after)], "name string")
    undo = {r.name: (r.new_name, r.outcome) for r in undo_plan(listing).collect()}
    assert undo["group-01-a.jpg"] == ("a.jpg", "renamed")
    assert undo["group-01-b.jpg"] == ("b.jpg", "renamed")
    assert undo["group-02-c.jpg"] == ("c.jpg", "conflict")
    assert undo["group-5-e.jpg"] == ("e.jpg", "renamed")
