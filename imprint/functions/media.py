"""Sizes, dimensions, formats and statuses of the organise plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plan statuses, in the order the summary lists them.
STATUSES = ["RENAMED", "CONVERTED", "COPIED", "DRY_RUN", "NO_CHANGE", "ERROR", "ERROR_EXISTS"]
SIZED_STATUSES = ["RENAMED", "CONVERTED", "COPIED", "DRY_RUN"]
KEEP_ORIGINAL_BELOW = 0.10  # a same-format re-encode saving less than 10 % keeps the original


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def human_size(size: Column | str) -> Column:
    """C14: ``N B`` below 1 KiB, one-decimal ``KB`` below 1 MiB, else ``MB``; NULL -> unknown.

    ``x / 1024`` and ``x / 2**20`` are exact in binary, so ``bround`` (half-even) before
    formatting gives the correctly rounded digit that ``%.1f`` of the exact value would.
    """
    s = _col(size)
    kb = F.format_string("%.1f KB", F.bround(s / 1024.0, 1))
    mb = F.format_string("%.1f MB", F.bround(s / 1048576.0, 1))
    return (
        F.when(s.isNull(), F.lit("unknown"))
        .when(s < 1024, F.concat(s.cast("string"), F.lit(" B")))
        .when(s < 1048576, kb)
        .otherwise(mb)
    )


def resized_dims(w: Column | str, h: Column | str, short_side: int | None, long_side: int | None) -> tuple[Column, Column]:
    """Target ``(width, height)``; never upscale, keep aspect, truncate; short side wins.

    Aspect is ``w / h`` in double and the other side is ``int(side / aspect)`` or
    ``int(side * aspect)``, truncated toward zero - a very thin image may get a 0 side.
    """
    w, h = _col(w), _col(h)
    side = short_side or long_side
    if not side:
        return w, h
    aspect = w.cast("double") / h.cast("double")
    if short_side:
        width_is_key = w < h
    else:
        width_is_key = w > h
    key_w = width_is_key & (w > side)
    key_h = ~width_is_key & (h > side)
    new_w = F.when(key_w, F.lit(side)).when(key_h, (F.lit(side) * aspect).cast("int")).otherwise(w)
    new_h = F.when(key_w, (F.lit(side) / aspect).cast("int")).when(key_h, F.lit(side)).otherwise(h)
    return new_w.cast("int"), new_h.cast("int")


def source_format(decoded_format: Column | None, name: Column | str) -> Column:
    """C11: the decoder's format name if known, else the extension; lower case."""
    from imprint.functions.naming import split_ext

    ext = F.regexp_replace(split_ext(name)[1], r"^\.", "")
    fmt = ext if decoded_format is None else F.coalesce(decoded_format, ext)
    return F.lower(fmt)


def same_format(src_fmt: Column, target_format: str) -> Column:
    """C11: format equality where ``jpg`` and ``jpeg`` are one format."""
    tgt = target_format.lower()
    if tgt in ("jpg", "jpeg"):
        return src_fmt.isin("jpg", "jpeg")
    return src_fmt == F.lit(tgt)


def keep_original(original_size: Column, encoded_size: Column, fmt_same: Column, dims_same: Column) -> Column:
    """Copy the original when format and dimensions are unchanged and the re-encode
    saves less than 10 % (strictly)."""
    saving = (original_size - encoded_size).cast("double") / original_size.cast("double")
    return fmt_same & dims_same & (original_size > 0) & (saving < KEEP_ORIGINAL_BELOW)


def dims_note(ow: Column, oh: Column, nw: Column, nh: Column) -> Column:
    """C17: ``WxH -> WxH`` when the dimensions change, else NULL."""
    changed = (ow != nw) | (oh != nh)
    return F.when(changed, F.format_string("%dx%d -> %dx%d", ow, oh, nw, nh))
