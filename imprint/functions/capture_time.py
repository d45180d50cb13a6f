"""Capture time of a file: EXIF, then file name, then modification time.

All results are ``timestamp_ntz`` (naive local time, second precision from EXIF and names).
Parsing is done with regular expressions and ``try_make_timestamp_ntz`` so invalid calendar
values give NULL, as a strict parser would; second 60 and year 0 are rejected explicitly
because ``make_timestamp`` would accept them.  ``\\d`` and ``\\s`` are ASCII-only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imprint.functions.naming import split_ext

# File-name date patterns, tried in this order on the name without extension.
#   1  YYYY-MM-DD HH:MM:SS      2  YYYY-MM-DD_HH-MM-SS      3  YYYY-MM-DD
#   4  YYYYMMDD_HH-MM-SS        5  YYYYMMDD                  6  DD-MM-YYYY HH:MM:SS
NAME_PATTERNS = [
    r"(\d{4})[_\-\.](\d{2})[_\-\.](\d{2})[_\-\s](\d{2}):(\d{2}):(\d{2})",
    r"(\d{4})[_\-\.](\d{2})[_\-\.](\d{2})[_\-](\d{2})[_\-](\d{2})[_\-](\d{2})",
    r"(\d{4})[_\-\.](\d{2})[_\-\.](\d{2})",
    r"(\d{4})(\d{2})(\d{2})[_\-]?(\d{2})[_\-]?(\d{2})[_\-]?(\d{2})",
    r"(\d{4})(\d{2})(\d{2})",
    r"(\d{2})[_\-\.](\d{2})[_\-\.](\d{4})[_\-\s](\d{2}):(\d{2}):(\d{2})",
]
NOON = 12  # a date without a time means 12:00:00

# EXIF date layout "YYYY:MM:DD HH:MM:SS"; month, day and time fields may have one digit.
EXIF_LAYOUT = r"^(\d{4}):(\d{1,2}):(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$"


def _ts(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    ok = (y >= 1) & (s <= 59)
    return F.when(ok, F.try_make_timestamp_ntz(y, mo, d, h, mi, s))


def exif_time(original: Column | str, fallback: Column | str) -> Column:
    """DateTimeOriginal when non-empty, else DateTime; a malformed first value gives NULL."""
    o = F.col(original) if isinstance(original, str) else original
    f = F.col(fallback) if isinstance(fallback, str) else fallback
    s = F.coalesce(F.nullif(o, F.lit("")), f)
    g = [F.regexp_extract(s, EXIF_LAYOUT, k).try_cast("int") for k in range(1, 7)]
    return F.when(s.rlike(EXIF_LAYOUT), _ts(*g))


def _widths(pattern: str) -> list[int]:
    """Digit counts of the groups of a pattern, read from its ``\\d{n}`` parts."""
    return [int(n) for n in re.findall(r"\\d\{(\d)\}", pattern)]


def name_time_from_stem(df: DataFrame, stem: str, out: str = "name_time") -> DataFrame:
    """First of the six patterns that yields a valid date, on the name without extension.

    A pattern whose leftmost match is not a valid date passes to the next pattern.  A first
    group above 31 is a year; otherwise six groups are read day, month, year, time.  Each
    pattern runs once per row: the digits of its leftmost match are kept and sliced by the
    group widths (separators are single non-digit characters).
    """
    tmp = []
    for i, pat in enumerate(NAME_PATTERNS):
        df = df.withColumn(f"_m{i}", F.regexp_replace(F.regexp_extract(stem, pat, 0), "[^0-9]", ""))
        tmp.append(f"_m{i}")
    cands = []
    for i, pat in enumerate(NAME_PATTERNS):
        m = F.col(f"_m{i}")
        g, pos = [], 1
        for w in _widths(pat):
            g.append(F.substring(m, pos, w).try_cast("int"))
            pos += w
        year_first = g[0] > 31
        if len(g) == 3:
            ts = F.when(year_first, _ts(g[0], g[1], g[2], F.lit(NOON), F.lit(0), F.lit(0)))
        else:
            # one constructor call per pattern: the group order is picked by the first group
            y = F.when(year_first, g[0]).otherwise(g[2])
            d = F.when(year_first, g[2]).otherwise(g[0])
            ts = _ts(y, g[1], d, g[3], g[4], g[5])
        cands.append(F.when(m != "", ts))
    return df.withColumn(out, F.coalesce(*cands)).drop(*tmp)


def file_time(mtime: Column | str) -> Column:
    """C4: modification time as naive local time (session time zone); NULL stays NULL."""
    m = F.col(mtime) if isinstance(mtime, str) else mtime
    return m.cast("timestamp_ntz")


def with_capture_time(
    df: DataFrame,
    exif_original: str | None = "exif_original",
    exif_datetime: str | None = "exif_datetime",
    name: str = "name",
    mtime: str | None = "mtime",
) -> DataFrame:
    """Add ``exif_time``, ``name_time``, ``capture_time`` and ``time_source``.

    Priority EXIF, then name, then mtime; missing input columns count as NULL.
    """
    cols = set(df.columns)

    def c(x: str | None, t: str) -> Column:
        return F.col(x) if x and x in cols else F.lit(None).cast(t)

    df = df.withColumn("exif_time", exif_time(c(exif_original, "string"), c(exif_datetime, "string")))
    df = df.withColumn("_stem", split_ext(name)[0])
    df = name_time_from_stem(df, "_stem").drop("_stem")
    e, n, m = F.col("exif_time"), F.col("name_time"), file_time(c(mtime, "timestamp_ntz"))
    return df.withColumn("capture_time", F.coalesce(e, n, m)).withColumn(
        "time_source", F.when(e.isNotNull(), "exif").when(n.isNotNull(), "name").when(m.isNotNull(), "mtime")
    )
