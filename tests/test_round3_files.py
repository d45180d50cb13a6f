"""Index buckets and pointers, exact decoding, images outside the index, ranged headers."""

import os
import re
import struct

import pytest
from pyspark.sql import functions as F

from imprint.operators.index import index_changes, to_hash, update_index
from imprint.sources.exif import Ranged, exif_tags, read_exif
from imprint.plans.jobs import find_similar, refresh_index
from imprint.sources.images import decode_wanted, hash_one
from imprint.sources.index_store import append_index, read_index, retain_index, write_index
from imprint.sources.listing import list_images
from test_files import _tiff_with_dates, pattern, png_bytes

SCHEMA = "path string, mtime timestamp_ntz, h long"


def rows(n, extra=0):
    return [(f"d/{i}", None, i + extra) for i in range(n)]


def test_reconciling_does_not_shuffle_the_index(spark, tmp_path):
    base = str(tmp_path / "it's an index")
    write_index(spark.createDataFrame(rows(500), SCHEMA), base)
    index = read_index(spark, base).select("path", "mtime", "h")
    listing = spark.createDataFrame([(f"d/{i}", None) for i in range(250, 700)], "path string, mtime timestamp_ntz")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        changes = index_changes(listing, index, carry="h")
        plan = changes._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan parquet" in x)
    assert "Bucketed: true" in lines[scan] or "SelectedBucketsCount" in lines[scan]
    join = next(i for i, x in enumerate(lines) if "Join" in x)
    depth = [len(re.match(r"[\s:+|-]*", x)[0]) for x in lines]
    above, at = [], depth[scan]
    for i in range(scan - 1, join, -1):  # the operators between the scan and the join
        if depth[i] < at:
            above.append(lines[i])
            at = depth[i]
    assert above and not any("Exchange" in x for x in above), plan
    assert plan.count("Exchange hashpartitioning") == 1  # the listing's side
    counts = {r["action"]: r["count"] for r in changes.groupBy("action").count().collect()}
    assert counts == {"new": 200, "unchanged": 250, "deleted": 250}
    kept = update_index(index, changes, spark.createDataFrame([("d/600", None, 6, True)], SCHEMA + ", ok boolean"))
    assert {(r.path, r.h) for r in kept.collect()} == {(f"d/{i}", i) for i in range(250, 500)} | {("d/600", 6)}
    again = update_index(index, changes.drop("old_h"), spark.createDataFrame([], SCHEMA + ", ok boolean"))
    assert again.count() == 250


def test_latest_mtime_of_a_repeated_path(spark):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    listing = spark.range(2).select(F.lit("p").alias("path"), F.when(F.col("id") == 0, at("2024-01-01")).otherwise(at("2024-05-05")).alias("mtime"))
    index = spark.range(1).select(F.lit("p").alias("path"), at("2024-05-05").alias("mtime"))
    assert [r.action for r in index_changes(listing, index).collect()] == ["unchanged"]


def test_damaged_pages_behind_good_footers(spark, tmp_path):
    base = str(tmp_path / "idx")
    write_index(spark.createDataFrame(rows(3000), SCHEMA), base, buckets=1)
    live = (tmp_path / "idx" / "_CURRENT.1").read_text()
    for f in (tmp_path / "idx" / live).glob("*.parquet"):
        b = bytearray(f.read_bytes())
        b[4:2000] = b"\xff" * 1996
        f.write_bytes(b)
    for f in (tmp_path / "idx" / live).glob(".*.crc"):
        f.unlink()
    assert read_index(spark, base, verify=True).count() == 0


def test_pointers_are_exclusive_and_old_folders_go(spark, tmp_path):
    base = str(tmp_path / "idx")
    one = spark.createDataFrame(rows(5), SCHEMA)
    assert [write_index(one, base, buckets=2), append_index(spark.createDataFrame(rows(2, 50), SCHEMA), base)] == [1, 2]
    (tmp_path / "idx" / "_CURRENT.3").write_text("")  # a writer died after making its pointer
    assert read_index(spark, base).count() == 5
    assert write_index(one, base) == 4
    (tmp_path / "idx" / "index-leftover").mkdir()
    gone = retain_index(spark, base, versions=1)
    assert len(gone) == 3 and "index-leftover" in gone
    assert sorted(p.name for p in (tmp_path / "idx").glob("_CURRENT.*")) == ["_CURRENT.4"]
    assert read_index(spark, base).count() == 5
    with pytest.raises(ValueError):
        retain_index(spark, base, versions=0)


@pytest.fixture(scope="module")
def big_folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("many [x] {1,2}")
    for i in range(200):
        (d / f"p{i}*.png").write_bytes(png_bytes(pattern(i, 16)))
        os.utime(d / f"p{i}*.png", (1_600_000_000 + i, 1_600_000_000 + i))
    return d


def test_one_old_file_decodes_one_file(spark, big_folder):
    listing = list_images(spark, str(big_folder)).select("path", "mtime")
    index = listing.where(~F.col("path").endswith("/p100*.png")).withColumn("h", F.lit(1).cast("long"))
    wanted = to_hash(index_changes(listing, index))
    decoded = decode_wanted(spark, str(big_folder), wanted)
    assert [r.path.rsplit("/", 1)[1] for r in decoded.select("path").collect()] == ["p100*.png"]
    import imprint.sources.images as images

    most, images.EXACT_PATHS = images.EXACT_PATHS, 0
    try:
        assert decode_wanted(spark, str(big_folder), wanted).count() == 1  # the folder scan gives the same rows
    finally:
        images.EXACT_PATHS = most


def test_query_image_outside_the_index(spark, tmp_path):
    d, other = tmp_path / "in", tmp_path / "elsewhere"
    d.mkdir(), other.mkdir()
    for i in range(4):
        (d / f"p{i}.png").write_bytes(png_bytes(pattern(i)))
    (other / "q 1%.png").write_bytes(png_bytes(pattern(2)))
    (other / "p2.png").write_bytes(png_bytes(pattern(2)))
    (other / "junk.png").write_bytes(b"not an image")
    base = str(tmp_path / "index")
    near, far = find_similar(spark, str(d), base, str(other / "q 1%.png"), threshold=0)
    assert [r.path.rsplit("/", 1)[1] for r in near.collect()] == ["p2.png"]
    assert far.count() == 3
    near, far = find_similar(spark, str(d), base, str(other / "p2.png"), threshold=0)
    assert near.count() == 0 and far.count() == 3  # the same base name is left out (F2)
    near, _ = find_similar(spark, str(d), base, str(d / "p2.png"), threshold=0)
    assert near.count() == 0
    assert refresh_index(spark, str(d), base)[0].count() == 4  # the query is not added
    for bad in ("junk.png", "missing.png"):
        with pytest.raises(ValueError, match=bad):
            find_similar(spark, str(d), base, str(other / bad))
    assert hash_one(spark, str(other / "p2.png")) == hash_one(spark, str(d / "p2.png"))


ORIGINAL, PLAIN = "2023:07:08 09:10:11", "2024:01:02 03:04:05"


def big_files():
    """Files of five megabytes whose dates come late, or lie behind large chunks."""
    tiff, filler = _tiff_with_dates(ORIGINAL, PLAIN), bytes(5 << 20)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"crc!"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", filler) + chunk(b"eXIf", tiff) + chunk(b"IEND", b"")
    piece = lambda kind, data: kind + struct.pack("<I", len(data)) + data + bytes(len(data) % 2)
    body = piece(b"VP8 ", filler[:-1]) + piece(b"EXIF", b"Exif\0\0" + tiff)
    webp = b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body
    app = b"".join(b"\xff\xe2" + struct.pack(">H", 60_002) + filler[:60_000] for _ in range(3))
    jpeg = b"\xff\xd8" + app + b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xda" + filler
    # a TIFF whose directory is at its end
    late = struct.pack("<H", 1) + struct.pack("<HHI", 306, 2, 20) + struct.pack("<I", 8) + struct.pack("<I", 0)
    strip = PLAIN.encode() + b"\0" + filler
    bare = b"II*\0" + struct.pack("<I", 8 + len(strip)) + strip + late
    no_dates = b"\xff\xd8" + b"\xff\xda" + filler
    return {"a b.png": png, "w.webp": webp, "j%20.jpg": jpeg, "t.tif": bare, "none.jpeg": no_dates, "cut.png": png[: 6 << 19]}


def test_headers_are_read_by_ranges(spark, tmp_path):
    import io

    want = {
        "a b.png": (ORIGINAL, PLAIN), "w.webp": (ORIGINAL, PLAIN), "j%20.jpg": (ORIGINAL, PLAIN), "t.tif": (None, PLAIN),
        "none.jpeg": (None, None), "cut.png": (None, None),
    }
    d = tmp_path / "large [1]"
    d.mkdir()
    for name, content in big_files().items():
        (d / name).write_bytes(content)
        ranged = Ranged(io.BytesIO(content), len(content))
        assert read_exif(ranged) == read_exif(content) == want[name], name
        assert ranged.bytes_read < 64 << 10, (name, ranged.bytes_read)
    (d / "empty.png").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: (r.exif_original, r.exif_datetime) for r in exif_tags(spark, str(d)).collect()}
    assert {k: v for k, v in got.items() if k in want} == {k: v for k, v in want.items() if k in got}
    assert {"a b.png", "j%20.jpg", "none.jpeg", "cut.png"} <= set(got)
    import imprint.sources.exif as exif

    before, exif._rangeable = exif._rangeable, lambda *_: False
    try:  # a store that only Spark opens
        same = {r.path.rsplit("/", 1)[1]: (r.exif_original, r.exif_datetime) for r in exif_tags(spark, str(d)).collect()}
    finally:
        exif._rangeable = before
    assert same == got
