"""File-name columns: extension split, image predicate, date layouts, prefixes (F1, F5, F6,
C6, C7, C15, C16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions accepted as images (compared in lower case).
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".heic", ".heif", ".webp", ".tiff")
IMAGE_NAME = r"\.(png|jpg|jpeg|gif|bmp|heic|heif|webp|tiff)$"

# base name, extension: the extension is the last ".xxx" with a non-dot character before it,
# so leading dots never start an extension (".jpg" has none, "a..jpg" has ".jpg").
_SPLIT = r"(?s)^(\.*[^.].*)(\.[^.]*)$"

GROUP_PREFIX = "group-"
GROUP_PREFIX_RE = r"^group-\d+-(.+)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_ext(name: Column | str) -> tuple[Column, Column]:
    """``(base, ext)`` like a path-extension split; ext includes the dot or is ''."""
    n = _col(name)
    has = n.rlike(_SPLIT)
    base = F.when(has, F.regexp_extract(n, _SPLIT, 1)).otherwise(n)
    ext = F.when(has, F.regexp_extract(n, _SPLIT, 2)).otherwise(F.lit(""))
    return base, ext


def is_image_name(name: Column | str) -> Column:
    """name ends, case-insensitively, with one of the image extensions."""
    return F.lower(_col(name)).rlike(IMAGE_NAME)


def norm_path(path: Column | str) -> Column:
    """One spelling per file: ``scheme:///x`` (empty authority) becomes ``scheme:/x``, as the
    ``binaryFile`` listing spells it; the ``image`` source reports the long form."""
    return F.regexp_replace(_col(path), r"^([A-Za-z][A-Za-z0-9+.\-]*):///", "$1:/")


def decoded_origin(origin: Column | str) -> Column:
    """The plain path of an ``image`` source origin, which is a percent-encoded URI ('+' is itself)."""
    o = _col(origin)
    return norm_path(F.coalesce(F.try_url_decode(F.replace(o, F.lit("+"), F.lit("%2B"))), o))


def local_path(path: Column | str) -> Column:
    """A path without the scheme of local files and without repeated or last slashes, so that a
    folder given by hand and a listed file's folder compare equal."""
    bare = F.regexp_replace(_col(path), r"^file:(//)?(?=/)", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?<!:)/{2,}", "/"), r"(?<=.)/+$", "")


def basename(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def dirname(path: Column | str) -> Column:
    """Directory part without trailing slashes ('' for a bare name)."""
    return F.regexp_replace(F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1), "/+$", "")


# Strftime directives and their date_format equivalents.
STRFTIME_TO_SPARK = {
    "Y": "yyyy",
    "m": "MM",
    "d": "dd",
    "H": "HH",
    "M": "mm",
    "S": "ss",
    "y": "yy",
    "j": "DDD",
    "b": "MMM",
    "B": "MMMM",
    "a": "EEE",
    "A": "EEEE",
    "I": "hh",
    "p": "a",
    "f": "SSSSSS",
}


def spark_layout(strftime_layout: str) -> str:
    """Translate a strftime layout into a ``date_format`` pattern; literals are quoted."""
    out: list[str] = []
    literal: list[str] = []

    def flush() -> None:
        if literal:
            text = "".join(literal).replace("'", "''")
            out.append(f"'{text}'")
            literal.clear()

    i = 0
    while i < len(strftime_layout):
        ch = strftime_layout[i]
        if ch == "%":
            if i + 1 >= len(strftime_layout):
                raise ValueError("layout ends with a lone '%'")
            d = strftime_layout[i + 1]
            if d == "%":
                literal.append("%")
            elif d in STRFTIME_TO_SPARK:
                flush()
                out.append(STRFTIME_TO_SPARK[d])
            else:
                raise ValueError(f"unsupported directive %{d}")
            i += 2
        else:
            literal.append(ch)
            i += 1
    flush()
    return "".join(out)


def format_time(ts: Column | str, strftime_layout: str) -> Column:
    """A timestamp formatted by a strftime layout."""
    return F.date_format(_col(ts), spark_layout(strftime_layout))


def with_counter(name: Column | str, n: Column) -> Column:
    """``base_NNN.ext`` (three digits at least) for n > 0, the name itself for n = 0."""
    base, ext = split_ext(name)
    return F.when(n == 0, _col(name)).otherwise(F.concat(base, F.format_string("_%03d", n), ext))


def group_prefixed(name: Column | str, group_no: Column | str) -> Column:
    """``group-NN-<name>`` with at least two digits."""
    return F.concat(F.format_string("group-%02d-", _col(group_no)), _col(name))


def strip_group_prefix(name: Column | str) -> Column:
    """The name without its ``group-<n>-`` prefix, NULL when it does not parse."""
    n = _col(name)
    return F.when(n.rlike(GROUP_PREFIX_RE), F.regexp_extract(n, GROUP_PREFIX_RE, 1))
