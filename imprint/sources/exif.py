"""EXIF capture-time tags from file headers.

The listing is dealt to tasks (``mapInPandas``), and each file is opened there and read by ranges:
JPEG APP1 ``Exif`` segments up to the scan, PNG ``eXIf`` and WebP ``EXIF`` chunks, whose other chunks
are skipped by their length, and bare TIFF headers.  From IFD0 it reads DateTime (tag 306) and from
the Exif sub-IFD DateTimeOriginal (36867), so a few pages of each file are read, whatever its size.
Where files lie in a store that only Spark can open, their contents come through ``binaryFile``.
Anything unreadable gives NULLs; a file never fails the job.  The strings then go through
:func:`capture_time.exif_time`.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from imprint._ship import ship_with_tasks
from imprint.functions.naming import basename, is_image_name
from imprint.sources.listing import list_images, listed_path, literal_path

ship_with_tasks(__name__)

# EXIF tag numbers.
TAG_DATETIME = 306
TAG_EXIF_IFD = 34665
TAG_DATETIME_ORIGINAL = 36867
ASCII = 2

OUT_SCHEMA = "path string, exif_original string, exif_datetime string"


PAGE = 4096  # bytes of a file that are read at once
MAX_TAGS = 4096  # entries of a directory that are looked at; real ones have some dozens


class Ranged:
    """A window of a file that is read page by page, as it is sliced; a slice past its end is
    short, as with bytes."""

    def __init__(self, file: BinaryIO, size: int, start: int = 0, pages: dict[int, bytes] | None = None) -> None:
        self.file, self.size, self.start = file, size, start
        self.pages = {} if pages is None else pages

    def __len__(self) -> int:
        return self.size

    @property
    def bytes_read(self) -> int:
        return sum(map(len, self.pages.values()))

    def __getitem__(self, part: slice) -> bytes:
        a, b, _ = part.indices(self.size)
        a, b = a + self.start, b + self.start
        out = []
        for page in range(a // PAGE, -(-b // PAGE)):
            if page not in self.pages:
                self.file.seek(page * PAGE)
                self.pages[page] = self.file.read(PAGE)
            at = page * PAGE
            out.append(self.pages[page][max(a - at, 0) : max(b - at, 0)])
        return b"".join(out)

    def window(self, a: int, b: int) -> Ranged:
        a, b = min(a, self.size), min(b, self.size)
        return Ranged(self.file, max(b - a, 0), self.start + a, self.pages)


Content = bytes | Ranged


def _window(content: Content, a: int, b: int) -> Content:
    return content[a:b] if isinstance(content, bytes) else content.window(a, b)


def _number(content: Content, at: int, kind: str) -> int:
    return struct.unpack(kind, content[at : at + struct.calcsize(kind)])[0]


def _ifd_tags(tiff: Content, offset: int, endian: str) -> dict[int, tuple[int, int, bytes]]:
    n = min(_number(tiff, offset, endian + "H"), MAX_TAGS)
    entries = tiff[offset + 2 : offset + 2 + 12 * n]
    tags = {}
    for k in range(n):
        tag, typ, count = struct.unpack_from(endian + "HHI", entries, 12 * k)
        tags[tag] = (typ, count, entries[12 * k + 8 : 12 * k + 12])
    return tags


def _ascii(tiff: Content, entry: tuple[int, int, bytes], endian: str) -> str | None:
    typ, count, raw = entry
    if typ != ASCII:
        return None
    if count <= 4:
        data = raw[:count]
    else:
        at = struct.unpack(endian + "I", raw)[0]
        data = tiff[at : at + min(count, PAGE)]
    return data.split(b"\x00", 1)[0].decode("ascii", errors="replace")


def parse_tiff(tiff: Content) -> tuple[str | None, str | None]:
    """``(DateTimeOriginal, DateTime)`` from a TIFF-structured EXIF block."""
    if tiff[:2] == b"II":
        endian = "<"
    elif tiff[:2] == b"MM":
        endian = ">"
    else:
        return None, None
    tags = _ifd_tags(tiff, _number(tiff, 4, endian + "I"), endian)
    dt = _ascii(tiff, tags[TAG_DATETIME], endian) if TAG_DATETIME in tags else None
    orig = None
    if TAG_EXIF_IFD in tags:
        (sub,) = struct.unpack(endian + "I", tags[TAG_EXIF_IFD][2])
        sub_tags = _ifd_tags(tiff, sub, endian)
        if TAG_DATETIME_ORIGINAL in sub_tags:
            orig = _ascii(tiff, sub_tags[TAG_DATETIME_ORIGINAL], endian)
    return orig, dt


def exif_block(content: Content) -> Content | None:
    """The TIFF-structured EXIF block of a JPEG, PNG, WebP or TIFF file, if any."""
    head = content[:12]
    if head[:2] == b"\xff\xd8":  # JPEG: walk the marker segments up to the scan
        i = 2
        while i + 4 <= len(content):
            lead, marker, length = struct.unpack(">BBH", content[i : i + 4])
            if lead != 0xFF or marker == 0xDA:
                return None
            if marker == 0xE1 and content[i + 4 : i + 10] == b"Exif\x00\x00":
                return _window(content, i + 10, i + 2 + length)
            i += 2 + length
        return None
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        i = 8
        while i + 8 <= len(content):
            length, kind = struct.unpack(">I4s", content[i : i + 8])
            if kind == b"eXIf":
                return _window(content, i + 8, i + 8 + length)
            i += 12 + length
        return None
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        i = 12
        while i + 8 <= len(content):
            kind, length = struct.unpack("<4sI", content[i : i + 8])
            if kind == b"EXIF":
                skip = 6 if content[i + 8 : i + 14] == b"Exif\x00\x00" else 0
                return _window(content, i + 8 + skip, i + 8 + length)
            i += 8 + length + length % 2
        return None
    if head[:4] in (b"II*\x00", b"MM\x00*"):
        return content
    return None


def read_exif(content: Content | None) -> tuple[str | None, str | None]:
    try:
        block = exif_block(content) if content is not None and len(content) else None
        return parse_tiff(block) if block is not None else (None, None)
    except (struct.error, IndexError, KeyError, ValueError, OSError):
        return None, None


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a listed path and the path in it."""
    scheme, rest = re.fullmatch(r"(?:([a-z][a-z0-9+.-]*):)?(.*)", path, re.S).groups()
    if scheme in (None, "file"):
        return pafs.LocalFileSystem(), re.sub(r"^//(?=/)", "", rest)
    return pafs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")


def _ranged_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parsed = []
        for path, size in zip(pdf["path"], pdf["size_bytes"]):
            try:
                where, name = opened(path)
                with where.open_input_file(name) as file:
                    parsed.append(read_exif(Ranged(file, int(size))))
            except (FileNotFoundError, PermissionError):  # gone since it was listed, or not ours
                parsed.append((None, None))
        yield pd.DataFrame(
            {"path": pdf["path"], "exif_original": [p[0] for p in parsed], "exif_datetime": [p[1] for p in parsed]}
        )


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parsed = [read_exif(bytes(c) if c is not None else None) for c in pdf["content"]]
        yield pd.DataFrame(
            {
                "path": pdf["path"],
                "exif_original": [p[0] for p in parsed],
                "exif_datetime": [p[1] for p in parsed],
            }
        )


def _rangeable(spark: SparkSession, directory: str) -> bool:
    """Whether a folder's file system opens here as it would in the tasks."""
    try:
        opened(listed_path(spark, directory))
    except (OSError, ValueError, NotImplementedError, pa.ArrowException):
        return False
    return True


def exif_tags(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """``(path, exif_original, exif_datetime)`` for every image file of a folder."""
    files = list_images(spark, directory, recursive)
    if _rangeable(spark, directory):
        return files.select("path", "size_bytes").mapInPandas(_ranged_batches, OUT_SCHEMA)
    whole = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(literal_path(directory))
        .where(is_image_name(basename("path")))
    )
    return exif_from_content(whole)


def exif_from_content(files: DataFrame) -> DataFrame:
    """S8 on an existing ``(path, content)`` DataFrame."""
    return files.select("path", "content").mapInPandas(_parse_batches, OUT_SCHEMA)
