"""Real files: PNGs written from raw bytes, junk, upper-case names, a subfolder; EXIF headers."""

import struct
import zlib

import numpy as np
import pytest

from imprint.functions.bits import hamming
from imprint.sources.exif import exif_from_content, read_exif
from imprint.sources.images import decode, hash_files
from imprint.sources.listing import list_images


def png_bytes(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    raw = b"".join(b"\x00" + rgb[y].astype(np.uint8).tobytes() for y in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data) & 0xFFFFFFFF)

    ihdr = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", ihdr) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def pattern(seed: int, size: int = 64) -> np.ndarray:
    rng = np.random.default_rng(seed)
    coarse = rng.integers(0, 256, size=(8, 8, 3))
    return np.kron(coarse, np.ones((size // 8, size // 8, 1))).astype(np.uint8)


@pytest.fixture(scope="module")
def image_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("images")
    base = pattern(1)
    (d / "base.png").write_bytes(png_bytes(base))
    (d / "up2.png").write_bytes(png_bytes(np.kron(base, np.ones((2, 2, 1))).astype(np.uint8)))
    (d / "bright.png").write_bytes(png_bytes(np.clip(base.astype(int) + 20, 0, 255).astype(np.uint8)))
    (d / "other.png").write_bytes(png_bytes(pattern(2)))
    (d / "A.PNG").write_bytes(png_bytes(pattern(3)))
    (d / "junk.jpg").write_bytes(b"not an image at all")
    (d / "notes.txt").write_bytes(b"hello")
    return d


def test_listing_is_case_insensitive_and_flat(spark, image_dir):
    names = {r.name for r in list_images(spark, str(image_dir)).collect()}
    assert names == {"base.png", "up2.png", "bright.png", "other.png", "A.PNG", "junk.jpg"}


def test_decode_and_hash(spark, image_dir):
    dec = decode(spark, str(image_dir))
    rows = {r.path.rsplit("/", 1)[1]: r for r in dec.select("path", "width", "ok").collect()}
    assert rows["junk.jpg"].ok is False and rows["base.png"].width == 64
    for method in ("phash", "ahash", "dhash", "whash"):
        hs = {r.path.rsplit("/", 1)[1]: (r.h, r.ok) for r in hash_files(dec, method).collect()}
        assert hs["junk.jpg"] == (None, False)
        d = spark.createDataFrame(
            [(hs["base.png"][0], hs["up2.png"][0], hs["bright.png"][0], hs["other.png"][0])], "a long, b long, c long, d long"
        ).select(hamming("a", "b"), hamming("a", "c"), hamming("a", "d")).first()
        assert d[0] <= 2, method  # 2x upscale
        assert d[1] <= 8, method  # brightened
        assert d[2] > d[1], method  # unrelated pattern is farther


def _tiff_with_dates(original: str, plain: str) -> bytes:
    # II, IFD0 at 8 with DateTime and an Exif IFD pointer; Exif IFD with DateTimeOriginal
    o, p = original.encode() + b"\x00", plain.encode() + b"\x00"
    ifd0_at, exif_at = 8, 8 + 2 + 2 * 12 + 4
    data_at = exif_at + 2 + 12 + 4
    ifd0 = struct.pack("<H", 2) + struct.pack("<HHI", 306, 2, len(p)) + struct.pack("<I", data_at)
    ifd0 += struct.pack("<HHI", 34665, 4, 1) + struct.pack("<I", exif_at) + struct.pack("<I", 0)
    exif = struct.pack("<H", 1) + struct.pack("<HHI", 36867, 2, len(o)) + struct.pack("<I", data_at + len(p))
    exif += struct.pack("<I", 0)
    return b"II*\x00" + struct.pack("<I", ifd0_at) + ifd0 + exif + p + o


def test_exif_headers(spark):
    tiff = _tiff_with_dates("2023:07:08 09:10:11", "2024:01:02 03:04:05")
    jpeg = b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\x00\x00" + tiff + b"\xff\xd9"
    assert read_exif(jpeg) == ("2023:07:08 09:10:11", "2024:01:02 03:04:05")
    assert read_exif(b"garbage") == (None, None)
    df = spark.createDataFrame([("x.jpg", jpeg), ("y.jpg", b"\xff\xd8\xff\xe1\x00")], "path string, content binary")
    got = {r.path: (r.exif_original, r.exif_datetime) for r in exif_from_content(df).collect()}
    assert got == {"x.jpg": ("2023:07:08 09:10:11", "2024:01:02 03:04:05"), "y.jpg": (None, None)}


def test_hash_only_changed_files(spark, tmp_path):
    import os
    import time

    from pyspark.sql import functions as F

    from imprint.operators.index import index_changes, to_hash, update_index
    from imprint.sources.images import hash_changed
    from imprint.sources.listing import list_images

    d = tmp_path / "lib"
    d.mkdir()
    for i in range(3):
        (d / f"p{i}.png").write_bytes(png_bytes(pattern(10 + i)))
    old_t = time.time() - 3600
    for i in range(3):
        os.utime(d / f"p{i}.png", (old_t, old_t))
    listing = list_images(spark, str(d))
    first = hash_changed(spark, str(d), to_hash(index_changes(listing, spark.createDataFrame([], "path string, mtime timestamp_ntz"))))
    index = update_index(spark.createDataFrame([], "path string, mtime timestamp_ntz, h long"),
                         index_changes(listing, spark.createDataFrame([], "path string, mtime timestamp_ntz")), first)
    index = spark.createDataFrame(index.collect(), "path string, mtime timestamp_ntz, h long")
    assert index.count() == 3
    (d / "p1.png").write_bytes(png_bytes(pattern(99)))  # modified now
    (d / "p3.png").write_bytes(png_bytes(pattern(13)))  # new
    os.remove(d / "p2.png")  # deleted
    listing = list_images(spark, str(d))
    ch = index_changes(listing, index)
    wanted = to_hash(ch)
    hashed = hash_changed(spark, str(d), wanted)
    assert {r.path.rsplit("/", 1)[1] for r in hashed.collect()} == {"p1.png", "p3.png"}
    new = {r.path.rsplit("/", 1)[1]: r.h for r in update_index(index, ch, hashed).collect()}
    old = {r.path.rsplit("/", 1)[1]: r.h for r in index.collect()}
    assert set(new) == {"p0.png", "p1.png", "p3.png"}
    assert new["p0.png"] == old["p0.png"] and new["p1.png"] != old["p1.png"]
