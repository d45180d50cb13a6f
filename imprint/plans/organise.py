"""Organise plan: capture-time names, collision counters, resize and convert decisions
(P3, P4, P5, W1, W2, S7, C5-C13, C17).

The plan is one DataFrame pipeline: a row per image file with its new name and status.  Nothing
is moved; applying the plan is a separate, idempotent step for the caller.

Name collisions are resolved in two set-based steps (no per-file state, no sequential loop):

* **W1 counter** - files whose target names are equal are numbered in listing order (name,
  then key); the first keeps the name, the n-th gets ``base_NNN.ext``.
* **W2 next free name** - when a target is already taken in the destination folder (a name
  present at the start, or another file's planned name) the claimant moves on to
  ``base_001.ext``, ``base_002.ext`` ...  Claimants of a target ``T`` are numbered ``k =
  0, 1, ...``; the excluded slots ``j`` of ``T`` (taken names that spell ``T`` or ``T_j``, and
  other claims that spell ``T_j``) are sorted, and ``f_i = j_i - i`` counts the free slots
  before the ``i``-th of them.  Merging claimants (at ``k``) and exclusions (at ``f_i``, first
  on ties) in one order per target, a claimant's 0-based position in that merge is exactly its
  slot.  Slots spell distinct names across targets, so the result is collision-free.

Both numberings use :func:`imprint.operators.ranking.number_rows`, which splits a hot target
(one name claimed by a third of all files) over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imprint.functions.capture_time import with_capture_time
from imprint.functions.media import (
    dims_note,
    human_size,
    keep_original,
    resized_dims,
    same_format,
    source_format,
)
from imprint.functions.naming import format_time, is_image_name, split_ext, with_counter
from imprint.operators.ranking import number_rows
from imprint.session import cut_lineage


@dataclass(frozen=True)
class OrganiseOptions:
    date_format: str = "%Y%m%d_%H%M%S"
    rename: bool = False
    convert: bool = False
    target_format: str = "jpg"
    out: str = "out"
    quality: int = 85
    short_side: int | None = None
    long_side: int | None = None
    dry_run: bool = False

    def __post_init__(self):
        if self.short_side and self.long_side:
            raise ValueError("short_side and long_side are mutually exclusive")  # C9

    @property
    def converting(self) -> bool:  # C10: resizing implies conversion
        return bool(self.convert or self.short_side or self.long_side)


def output_dir(directory: Column, opts: OrganiseOptions) -> Column:
    """Where outputs go - the input folder, or ``out`` under it unless ``out`` is absolute."""
    if not opts.converting:
        return directory
    if opts.out.startswith("/"):
        return F.lit(opts.out)
    return F.concat(F.regexp_replace(directory, "/+$", ""), F.lit("/" + opts.out))


_SLOT = r"^(.*)_([0-9]{3,18})$"


def _slots(names: DataFrame, col: str) -> DataFrame:
    """Names spelled exactly as a counter slot ``T_NNN``: ``(target=T, j=NNN)``, staged column by
    column so every regex runs once per row."""
    base, ext = split_ext(col)
    df = names.select(base.alias("_rb"), ext.alias("_re")).where(F.col("_rb").rlike(_SLOT))
    df = df.select(
        F.concat(F.regexp_extract("_rb", _SLOT, 1), F.col("_re")).alias("target"),
        F.regexp_extract("_rb", _SLOT, 2).alias("_digits"),
    ).withColumn("j", F.col("_digits").try_cast("long"))
    ok = F.col("j").isNotNull() & (F.col("j") >= 1) & (F.format_string("%03d", F.col("j")) == F.col("_digits"))
    return df.where(ok).select("target", "j")


def next_free_names(claims: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """``claims(key, target, name)`` -> ``(key, final_name)``, unique and not in ``taken(name)``."""
    # After W1 a name is claimed at most twice: as a target itself (counter 0) and as the one
    # parent it parses back to (counter >= 1); so a plain window cannot meet a hot group here.
    c = claims.withColumn("_k", F.row_number().over(Window.partitionBy("target").orderBy("name", key)) - 1)
    c = c.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("target")))
    held = taken.select(F.col("name").alias("target")).distinct().withColumn("_held", F.lit(True))
    c = cut_lineage(c.join(held, "target", "left"), "claims")
    # a target that one file claims and nobody holds is that file's name; only the rest is merged
    alone = (F.col("_n") == 1) & F.col("_held").isNull()
    free = c.where(alone).select(key, F.col("target").alias("final_name"))
    c = c.where(~alone)
    targets = c.select("target").distinct()
    reserved = taken.select(F.col("name").alias("r")).union(claims.select(F.col("target").alias("r"))).distinct()
    excl = (
        _slots(reserved, "r")
        .unionByName(taken.select(F.col("name").alias("target"), F.lit(0).cast("long").alias("j")))
        .distinct()
        .join(targets, "target", "left_semi")
    )
    excl = number_rows(excl, ["j"], partition_by=["target"], out="_i")
    merged = c.select("target", F.col("_k").alias("_pos"), F.lit(1).alias("_typ"), F.lit(None).cast("long").alias("_j"), key).unionByName(
        excl.select(
            "target",
            (F.col("j") - (F.col("_i") - 1)).alias("_pos"),
            F.lit(0).alias("_typ"),
            F.col("j").alias("_j"),
            F.lit(None).cast(claims.schema[key].dataType).alias(key),
        )
    )
    ranked = number_rows(merged, ["_pos", "_typ", "_j", key], partition_by=["target"], out="_rn")
    named = ranked.where(F.col("_typ") == 1).select(key, with_counter("target", F.col("_rn") - 1).alias("final_name"))
    return free.unionByName(named)


def organise_plan(
    listing: DataFrame,
    opts: OrganiseOptions,
    taken: DataFrame | None = None,
    key: str = "path",
) -> DataFrame:
    """One plan row per image file of ``listing``.

    ``listing`` needs ``name``, ``size_bytes`` and ``key``; optional columns ``exif_original``,
    ``exif_datetime``, ``mtime`` (capture time), ``width``/``height`` (decoded size, negative
    or NULL when the file cannot be decoded), ``encoded_size`` (size of the re-encoded file)
    and ``format`` (decoder's format name).  ``taken`` lists names already present in the
    destination folder; when renaming in place every listed name counts as taken.
    """
    cols = set(listing.columns)

    def opt(c: str, dtype: str) -> Column:
        return F.col(c) if c in cols else F.lit(None).cast(dtype)

    conv = opts.converting
    files = listing.where(is_image_name("name"))  # S1/F1
    if opts.rename:
        # stage boundary: the parsed times are a narrow table; fusing the parsers into the
        # numbering stage overflows the 64 KB generated-method limit
        files = cut_lineage(with_capture_time(files), "capture-time")
    base, ext = split_ext("name")
    ct, src = F.col("capture_time"), F.col("time_source")
    if opts.rename:
        new_ext = F.lit("." + opts.target_format.lower()) if conv else ext
        t0 = F.concat(format_time(ct, opts.date_format), new_ext)
    else:
        t0 = F.concat(base, F.lit("." + opts.target_format.lower())) if conv else F.col("name")
    df = files.select(
        key if key != "name" else F.col("name").alias("_nkey"),
        "name",
        F.col("size_bytes").alias("original_size"),
        opt("width", "bigint").cast("int").alias("_w"),
        opt("height", "bigint").cast("int").alias("_h"),
        opt("encoded_size", "bigint").alias("_enc"),
        opt("format", "string").alias("_fmt"),
        ct.alias("capture_time") if opts.rename else F.lit(None).cast("timestamp_ntz").alias("capture_time"),
        src.alias("time_source") if opts.rename else F.lit(None).cast("string").alias("time_source"),
        t0.alias("_t0"),
    )
    if key == "name":
        key = "_nkey"
    # Per target, in listing order
    df = number_rows(df.where(F.col("_t0").isNotNull()), ["name", key], partition_by=["_t0"], out="_c").unionByName(
        df.where(F.col("_t0").isNull()).withColumn("_c", F.lit(None).cast("long"))
    )
    df = df.withColumn("_t1", with_counter("_t0", F.col("_c") - 1))
    decodable = F.col("_w").isNotNull() & (F.col("_w") > 0) & F.col("_h").isNotNull() & (F.col("_h") > 0)
    nw, nh = resized_dims("_w", "_h", opts.short_side, opts.long_side)
    shrinks_to_none = decodable & ((nw < 1) | (nh < 1))  # a side of no pixels: the resize fails
    dims_same = (nw == F.col("_w")) & (nh == F.col("_h"))
    fmt_same = same_format(source_format(F.col("_fmt"), F.col("name")), opts.target_format)
    keep = keep_original(F.col("original_size"), F.col("_enc"), fmt_same, dims_same)
    unchanged = (F.col("_t1") == F.col("name")) & F.lit(not conv)
    no_time = F.col("_t1").isNull()
    if opts.dry_run:
        status = F.when(no_time, "ERROR").when(unchanged, "NO_CHANGE").otherwise("DRY_RUN")
    elif conv:
        status = (
            F.when(no_time | ~decodable | shrinks_to_none, "ERROR")
            .when(keep, "COPIED")
            .otherwise("CONVERTED")
        )
    else:
        status = F.when(no_time, "ERROR").when(unchanged, "NO_CHANGE").otherwise("RENAMED")
    df = df.withColumn("status", status)
    zero = F.lit(0)
    sized = F.col("status").isin("CONVERTED", "COPIED") | ((F.col("status") == "DRY_RUN") & F.lit(conv) & decodable)
    df = df.select(
        "*",
        F.when(sized, F.col("_w")).otherwise(zero).alias("orig_w"),
        F.when(sized, F.col("_h")).otherwise(zero).alias("orig_h"),
        F.when(F.col("status") == "COPIED", F.col("_w")).when(sized, nw).otherwise(zero).alias("new_w"),
        F.when(F.col("status") == "COPIED", F.col("_h")).when(sized, nh).otherwise(zero).alias("new_h"),
        F.when(F.col("status") == "CONVERTED", F.col("_enc"))
        .when((F.col("status") == "DRY_RUN") & sized, F.col("_enc"))
        .otherwise(F.col("original_size"))
        .alias("new_size"),
    )
    if not opts.dry_run:
        # stage boundary: W2 reads the written W1 plan instead of re-deriving it per branch
        df = cut_lineage(df, "plan-w1")
        moving = F.col("status").isin("RENAMED", "CONVERTED", "COPIED")
        names = taken.select("name") if taken is not None else None
        if not conv:
            in_place = listing.select("name")
            names = in_place if names is None else names.unionByName(in_place)
        if names is None:
            names = listing.sparkSession.createDataFrame([], "name string")
        claims = df.where(moving).select(key, F.col("_t1").alias("target"), "name")
        final = next_free_names(claims, names, key)
        df = df.join(final, key, "left").withColumn(
            "new_filename", F.when(moving, F.col("final_name")).otherwise(F.coalesce(F.col("_t1"), F.col("name")))
        )
    else:
        df = df.withColumn("new_filename", F.coalesce(F.col("_t1"), F.col("name")))
    out = df.select(
        F.col(key).alias("_key_out") if key == "_nkey" else F.col(key),
        F.col("name").alias("filename"),
        "new_filename",
        "status",
        "original_size",
        "new_size",
        "orig_w",
        "orig_h",
        "new_w",
        "new_h",
        "capture_time",
        "time_source",
        human_size("original_size").alias("original_size_str"),
        human_size("new_size").alias("new_size_str"),
        dims_note(F.col("orig_w"), F.col("orig_h"), F.col("new_w"), F.col("new_h")).alias("dims_note"),
    )
    return out.drop("_key_out")


__all__ = ["OrganiseOptions", "organise_plan", "next_free_names", "output_dir"]
