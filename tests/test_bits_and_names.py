import datetime as dt

from pyspark.sql import functions as F

from imprint.functions.bits import from_hex, hamming, similarity_label, to_hex
from imprint.functions.capture_time import exif_time, with_capture_time
from imprint.functions.media import human_size, resized_dims
from imprint.functions.naming import spark_layout, split_ext, strip_group_prefix, group_prefixed


def test_hamming_and_hex(spark):
    rows = [(-1, 0), (0, 0), (1 << 62, -(1 << 63)), (12345, 54321)]
    df = spark.createDataFrame(rows, "a long, b long")
    out = df.select(
        hamming("a", "b").alias("d"), to_hex("a").alias("x"), from_hex(to_hex("a")).alias("back"), "a", "b"
    ).collect()
    for r in out:
        assert r.d == bin((r.a ^ r.b) & ((1 << 64) - 1)).count("1")
        assert r.back == r.a
        assert len(r.x) == 16
    assert out[0].x == "ffffffffffffffff"


def test_similarity_labels(spark):
    df = spark.createDataFrame([(d,) for d in (0, 1, 5, 6, 10, 11, 15, 16, 64)], "d int")
    got = [r[0] for r in df.select(similarity_label("d")).collect()]
    assert got == ["exact", "very similar", "very similar", "similar", "similar", "recognisable", "recognisable",
                   "different", "different"]


def test_split_ext_like_python(spark):
    import os

    names = ["a.b.jpg", ".jpg", "noext", "a..jpg", "..jpg", ".a.jpg", "a.", "IMG_1.JPG", "x y.png"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    b, e = split_ext("name")
    got = {r.name: (r.b, r.e) for r in df.select("name", b.alias("b"), e.alias("e")).collect()}
    for n in names:
        assert got[n] == os.path.splitext(n), n


def test_layout_translation():
    assert spark_layout("%Y%m%d_%H%M%S") == "yyyyMMdd'_'HHmmss"
    assert spark_layout("%Y-%m-%d_%H-%M") == "yyyy'-'MM'-'dd'_'HH'-'mm"
    assert spark_layout("it's %Y") == "'it''s 'yyyy"


def _name_times(spark, names):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    out = with_capture_time(df, None, None, "name", None).orderBy("id").collect()
    return [r.name_time for r in out]


def test_name_patterns_table(spark):
    names = [
        "IMG_20240131_235959.jpg",  # pattern 4
        "2024-02-30_10-00-00.jpg",  # Feb 30: fails 2 and 3 -> NULL
        "2024-01-01_25-99-99.jpg",  # bad time in 2 -> noon by 3
        "2024-01-02 03:04:05.png",  # pattern 1
        "shot 2024-03-04_05-06-07.png",  # pattern 2
        "05-06-2024 07:08:09.jpg",  # pattern 6
        "IMG-20240215-WA7.jpg",  # pattern 5, noon
        "2024-01-01 10:00:60.jpg",  # second 60 rejected in 1 -> noon by 3
        "0025-01-01 10:00:00.jpg",  # first group <= 31: read day-month-year
        "DSC_1234.jpg",
        ".jpg",
    ]
    got = _name_times(spark, names)
    assert got == [
        dt.datetime(2024, 1, 31, 23, 59, 59),
        None,
        dt.datetime(2024, 1, 1, 12, 0, 0),
        dt.datetime(2024, 1, 2, 3, 4, 5),
        dt.datetime(2024, 3, 4, 5, 6, 7),
        dt.datetime(2024, 6, 5, 7, 8, 9),
        dt.datetime(2024, 2, 15, 12, 0, 0),
        dt.datetime(2024, 1, 1, 12, 0, 0),
        dt.datetime(1, 1, 25, 10, 0, 0),
        None,
        None,
    ]


def test_exif_rules(spark):
    rows = [
        ("2025:1:2 3:4:5", None),  # single digits accepted
        ("0000:00:00 00:00:00", "2024:01:01 00:00:00"),  # malformed original: no fallback
        ("", "2024:05:06 07:08:09"),  # empty original: fallback
        (None, None),
        ("2024:02:30 10:00:00", None),
    ]
    df = spark.createDataFrame(rows, "o string, d string")
    got = [r[0] for r in df.select(exif_time("o", "d")).collect()]
    assert got == [dt.datetime(2025, 1, 2, 3, 4, 5), None, dt.datetime(2024, 5, 6, 7, 8, 9), None, None]


def test_human_size_and_dims(spark):
    df = spark.createDataFrame([(0,), (1023,), (1280,), (1536,), (1048576,), (-5,), (None,)], "s long")
    got = [r[0] for r in df.select(human_size("s")).collect()]
    assert got == ["0 B", "1023 B", "1.2 KB", "1.5 KB", "1.0 MB", "-5 B", "unknown"]
    dims = spark.createDataFrame([(4000, 3000), (3000, 4000), (1000, 1000), (800, 600), (10000, 1)], "w int, h int")
    for short, long_, expect in [
        (1000, None, [(1333, 1000), (1000, 1333), (1000, 1000), (800, 600), (10000, 1)]),
        (None, 1000, [(1000, 750), (750, 1000), (1000, 1000), (800, 600), (1000, 0)]),
    ]:
        nw, nh = resized_dims("w", "h", short, long_)
        assert [tuple(r) for r in dims.select(nw, nh).collect()] == expect


def test_group_prefix(spark):
    df = spark.createDataFrame([("a.jpg", 3), ("b.jpg", 100)], "n string, g int")
    assert [r[0] for r in df.select(group_prefixed("n", "g")).collect()] == ["group-03-a.jpg", "group-100-b.jpg"]
    df2 = spark.createDataFrame([("group-03-a.jpg",), ("group-x-a.jpg",), ("group-1-group-2-a",)], "n string")
    assert [r[0] for r in df2.select(strip_group_prefix("n")).collect()] == ["a.jpg", None, "group-2-a"]
