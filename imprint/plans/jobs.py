"""The three jobs on a folder of real files: duplicates (E1), similar files (E2), organising.

Each joins the library's parts, takes and returns DataFrames, and changes nothing but the
fingerprint index.  Applying a plan is the caller's step; ``write_manifest`` keeps it as a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from imprint.functions.naming import dirname
from imprint.operators.grouping import duplicate_groups, group_listing
from imprint.operators.hamming import closest_non_duplicates, neighbours
from imprint.operators.index import action_counts, failures, index_changes, to_hash, update_index
from imprint.operators.pair_delta import distinct_hashes, first_pairs, update_pairs
from imprint.plans.group_rename import rename_plan
from imprint.plans.organise import OrganiseOptions, organise_plan, output_dir
from imprint.session import cut_lineage
from imprint.sources.exif import exif_tags
from imprint.sources.images import decode, hash_changed, hash_one
from imprint.sources.index_store import read_index, write_index
from imprint.sources.listing import list_files, list_images, listed_path
from imprint.sources.pair_store import read_pairs, write_pairs


def refresh_index(spark: SparkSession, directory: str, base: str, method: str = "phash") -> tuple[DataFrame, DataFrame]:
    """Bring the index under ``base`` up to date with a folder: ``(index, counts)``.

    Only new and changed files are hashed.  ``counts`` is one row: new, changed, unchanged,
    deleted, and ``n_failed`` files that could not be hashed (they are tried again next time).
    """
    listing = cut_lineage(list_images(spark, directory).select("path", "mtime"), "job-listing")
    old = read_index(spark, base, method, verify=True).select("path", "mtime", "h")
    changed, failed = Observation("changes"), Observation("failures")  # counted while the tables are written
    changes = index_changes(listing, old, carry="h").observe(changed, *action_counts())
    changes = cut_lineage(changes, "job-changes")
    hashed = hash_changed(spark, directory, to_hash(changes), method).observe(failed, failures())
    hashed = cut_lineage(hashed, "job-hashed")
    write_index(update_index(old, changes, hashed), base, method)
    counts = changed.get | failed.get
    counts = spark.createDataFrame([counts], ", ".join(f"{name} bigint" for name in counts))
    return read_index(spark, base, method).select("path", "mtime", "h"), counts


def refresh_pairs(spark: SparkSession, index: DataFrame, base: str, threshold: int, method: str = "phash") -> DataFrame:
    """Similar pairs of an index's hashes, kept beside it: only hashes that are new since the last
    run with this threshold are joined, and pairs of hashes that have gone are left out."""
    now = cut_lineage(distinct_hashes(index), "job-hashes")
    state = read_pairs(spark, base, method, threshold)
    pairs = first_pairs(now, threshold) if state is None else update_pairs(state[1], state[0], now, threshold)
    return write_pairs(now, pairs, base, method, threshold)[1]


def find_duplicates(
    spark: SparkSession, directory: str, base: str, threshold: int = 5, method: str = "phash"
) -> DataFrame:
    """The folder's near-duplicate groups in listing order (group, distance, path)."""
    index, _ = refresh_index(spark, directory, base, method)
    pairs = refresh_pairs(spark, index, base, threshold, method)
    return group_listing(duplicate_groups(index, threshold, key_col="path", pairs=pairs), "path")


def rename_duplicates(
    spark: SparkSession, directory: str, base: str, threshold: int = 5, method: str = "phash"
) -> DataFrame:
    """E1 with renaming: the ``group-NN-`` plan of the folder's near-duplicate groups."""
    groups = find_duplicates(spark, directory, base, threshold, method)
    return rename_plan(groups, directory, list_files(spark, directory).select("name"))


def find_similar(
    spark: SparkSession, directory: str, base: str, query: str, threshold: int = 5, method: str = "phash", k: int = 10
) -> tuple[DataFrame, DataFrame]:
    """The folder's files within ``threshold`` of one image, nearest first, and the ``k``
    closest beyond it.  The image may be any file: one that the index doesn't have, in another
    folder for instance, is decoded and hashed alone.  Raises ValueError if it can't be read."""
    index, _ = refresh_index(spark, directory, base, method)
    path = listed_path(spark, query)
    known = index.where(F.col("path") == path).select("h").first()  # one hash
    h = F.lit(known["h"] if known else hash_one(spark, path, method))
    near = neighbours(index, h, threshold, query_name=F.lit(path))
    return near, closest_non_duplicates(index, h, threshold, k, query_name=F.lit(path))


def organise_folder(spark: SparkSession, directory: str, opts: OrganiseOptions, ordered: bool = True) -> DataFrame:
    """The organise plan of one folder's images, with ``target_path``.

    Capture times come from EXIF headers, names and file times; sizes in pixels from the
    decoder, where converting asks for them.  ``ordered`` sorts the report by name (S2).
    """
    listing = list_images(spark, directory).join(exif_tags(spark, directory), "path", "left")
    if opts.converting:
        sizes = decode(spark, directory).select("path", "width", "height")
        listing = listing.join(sizes, "path", "left")
    listing = cut_lineage(listing, "job-listing")
    taken = None if opts.converting else list_files(spark, directory).select("name")
    plan = organise_plan(listing, opts, taken=taken, key="path")
    target = F.concat(output_dir(dirname("path"), opts), F.lit("/"), F.col("new_filename"))
    plan = plan.withColumn("target_path", F.when(F.col("status") != "ERROR", target))
    return plan.orderBy("filename") if ordered else plan


def write_manifest(plan: DataFrame, path: str) -> None:
    """Keep a plan as a parquet table; an existing one is not overwritten."""
    plan.write.mode("errorifexists").parquet(path)
