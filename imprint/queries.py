"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator family.

Every query reads the given tables (or data Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imprint import fixtures
from imprint.functions.bits import from_hex, similarity_label, to_hex
from imprint.operators import fingerprint as fpr
from imprint.operators.grouping import duplicate_groups, exact_duplicates, group_sizes, hash_stats
from imprint.operators.hamming import closest_non_duplicates, neighbours, similar_pairs
from imprint.operators.nearest import nearest_join
from imprint.operators.pair_delta import distinct_hashes, first_pairs, update_pairs
from imprint.oracle import ORGANISE_CASES
from imprint.functions import capture_time as ctm
from imprint.functions.naming import is_image_name, split_ext
from imprint.plans.organise import OrganiseOptions, organise_plan
from imprint.plans.summary import size_totals, status_histogram
from imprint.operators.index import failed_count, index_changes, run_counts, to_hash, update_index
from imprint.plans.group_rename import outcome_counts, rename_plan, undo_plan
from imprint.session import cut_lineage
from imprint.sources.images import resampled

Query = Callable[[SparkSession, str], DataFrame]


# ---------------------------------------------------------------- fingerprints


def fp_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8: median-threshold fingerprint of every embedding."""
    v = fixtures.embedding_vectors(spark, sf_dir)
    return v.select("id", fpr.median_fingerprint("vec").alias("h"))


def fp_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9: SimHash of every document."""
    d = fixtures.documents(spark, sf_dir)
    return d.select("id", fpr.simhash("text").alias("h"))


def _grid_query(method: str) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = fixtures.grid9x8(spark, sf_dir) if method == "dhash" else fixtures.grid8(spark, sf_dir)
        return fpr.fingerprint(g, "grid", method, "h").select("id", "h")

    q.__doc__ = f"H1-H4: {method} of the 8x8 grid of each embedding."
    return q


def fp_grid16_whash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: wavelet hash of a 16x16 grid (2x2 block means)."""
    g = fixtures.grid_tiled(spark, sf_dir, 16)
    return g.select("id", fpr.whash("grid", 16).alias("h"))


def fp_grid32_phash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: perceptual hash of a 32x32 grid (low 8x8 block of its DCT)."""
    return fpr.fingerprint(fixtures.grid_tiled(spark, sf_dir, 32), "grid", "phash", "h").select("id", "h")


def fp_blank_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document hashes whose upper half is blank, as in pictures with large empty areas."""
    return fp_docs(spark, sf_dir).select("id", F.col("h").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("h"))


def resample_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: a 24x20 grey picture of every embedding, resampled to the 9x8 grid of the dHash, and larger."""
    p = fixtures.grey_pictures(spark, sf_dir, 24, 20)
    small, large = resampled("cells", 24, 20, 9, 8), resampled("cells", 24, 20, 31, 20)
    p = p.select("id", small.alias("small"), large.alias("large"))
    return p.select("id", F.array_join("small", " ").alias("small"), F.array_join("large", " ").alias("large"))


def hash_hex_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6: hash -> 16 hex digits -> hash."""
    f = fp_embed(spark, sf_dir)
    return f.select("id", "h", to_hex("h").alias("h_hex")).withColumn("h_back", from_hex("h_hex"))


# ---------------------------------------------------------------- Hamming search / join


def _embed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fp_embed(spark, sf_dir)
    return f.select("id", F.concat(F.lit("img/"), F.col("id").cast("string"), F.lit(".png")).alias("path"), "h")


def _first_file(files: DataFrame):
    """The query file of E2: the file with the smallest id (scalar subqueries, no collect)."""
    qid = files.select(F.min("id")).scalar()
    qrow = files.where(F.col("id") == qid)
    return qrow.select("h").scalar(), qrow.select("path").scalar()


def neighbours_embed(t: int) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = _embed_files(spark, sf_dir)
        qh, qpath = _first_file(files)
        return neighbours(files, qh, t, query_name=qpath).select("id", "path", "distance", "rank")

    q.__doc__ = f"J4+T1+F2: files within {t} of one query file, the query itself excluded."
    return q


def closest_embed(t: int) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = _embed_files(spark, sf_dir)
        qh, qpath = _first_file(files)
        return closest_non_duplicates(files, qh, t, k=10, query_name=qpath).select("id", "path", "distance")

    q.__doc__ = f"T2+F3: the 10 closest files farther than {t} from the query file."
    return q


def closest10_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2+F3 for a batch: the 10 closest documents farther than 5 from every 20th document."""
    files = cut_lineage(fp_docs(spark, sf_dir), "nearest-docs")
    queries = files.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "h")
    return nearest_join(queries, files, k=10, beyond=5)


def closest10_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2+F3 for a batch: the 10 closest vectors farther than 20 from every 20th vector."""
    files = fp_embed(spark, sf_dir)
    queries = files.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "h")
    return nearest_join(queries, files, k=10, beyond=20)


def pairs_query(source: Query, t: int) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return similar_pairs(source(spark, sf_dir), t)

    q.__doc__ = f"J5: pairs of distinct hashes within {t} (banded exact join)."
    return q


def groups_query(source: Query, t: int) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return duplicate_groups(source(spark, sf_dir), t, key_col="id", hash_col="h")

    q.__doc__ = f"G1: greedy near-duplicate groups at threshold {t}."
    return q


def hamming_pairs_docs_delta_t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5+J3: pairs after a tenth of the documents came and a seventh went, from the pairs before."""
    files = cut_lineage(fp_docs(spark, sf_dir), "delta-files")
    before = cut_lineage(distinct_hashes(files.where(F.col("id") % 10 != 0)), "delta-before")
    now = cut_lineage(distinct_hashes(files.where(F.col("id") % 7 != 3)), "delta-now")
    pairs = cut_lineage(first_pairs(before, 5), "delta-pairs")
    return update_pairs(pairs, before, now, 5)


def pair_labels_embed_t22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5+C18: pairs within 22 with the threshold-guide wording of their distance."""
    return similar_pairs(fp_embed(spark, sf_dir), 22).withColumn("label", similarity_label("distance"))


def group_sizes_docs_t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: size of every duplicate group of documents at threshold 5."""
    return group_sizes(duplicate_groups(fp_docs(spark, sf_dir), 5))


def hash_stats_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: files and distinct hashes."""
    return hash_stats(fp_docs(spark, sf_dir))


def exact_duplicates_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: hashes shared by more than one document."""
    return exact_duplicates(fp_docs(spark, sf_dir)).select("h", "n_files", F.col("first_key").alias("first_id"))


# ---------------------------------------------------------------- organise side


def listing_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listed file with its base name, extension and image flag."""
    mf = fixtures.media_files(spark, sf_dir)
    base, ext = split_ext("name")
    return mf.select("event_id", "path", "name", base.alias("base"), ext.alias("ext"), is_image_name("name").alias("is_image"))


def capture_time_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXIF time, file-name time and the chosen capture time with its source."""
    mf = fixtures.media_files(spark, sf_dir)
    return ctm.with_capture_time(mf).select(
        "event_id", "name", "exif_time", "name_time", "capture_time", "time_source"
    )


def _organise(kw: dict) -> Query:
    opts = OrganiseOptions(**kw)

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        listing = fixtures.media_files(spark, sf_dir)
        taken = fixtures.existing_names(spark, sf_dir)
        return organise_plan(listing, opts, taken=taken, key="event_id")

    q.__doc__ = f"P3-P5: organise plan with {kw}."
    return q


def _summary(plan_q: Query, fn) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(plan_q(spark, sf_dir))

    q.__doc__ = f"A6-A8: {fn.__name__} of a plan."
    return q


# ---------------------------------------------------------------- index, rename and undo plans


def index_changes_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconcile the current listing with an older index state."""
    return index_changes(fixtures.media_files(spark, sf_dir), fixtures.media_prior(spark, sf_dir))


def index_run_counts_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: new / changed / unchanged / deleted counts of one index run."""
    return run_counts(index_changes_media(spark, sf_dir))


def _embed_groups_by_path(spark: SparkSession, sf_dir: str, t: int) -> DataFrame:
    files = fixtures.embedding_files(spark, sf_dir).join(fp_embed(spark, sf_dir), "id")
    return duplicate_groups(files, t, key_col="path", hash_col="h")


def rename_plan_embed(t: int) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        groups = _embed_groups_by_path(spark, sf_dir, t)
        return rename_plan(groups, "img", fixtures.embedding_dir_names(spark, sf_dir))

    q.__doc__ = f"P1/W3/J7: group-prefix rename plan for duplicate groups at threshold {t}."
    return q


def rename_counts_embed(t: int) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return outcome_counts(rename_plan_embed(t)(spark, sf_dir))

    q.__doc__ = f"A9: outcomes of the rename plan at threshold {t}."
    return q


def rename_plan_docs_t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group-prefix rename plan for the near-duplicate documents at threshold 5."""
    files = fixtures.document_files(spark, sf_dir).join(fp_docs(spark, sf_dir), "id")
    groups = duplicate_groups(files, 5, key_col="path", hash_col="h")
    return rename_plan(groups, "doc/", fixtures.document_dir_names(spark, sf_dir))


def _fresh_hashes(spark: SparkSession, sf_dir: str, changes: DataFrame) -> DataFrame:
    return fixtures.hashed_now(spark, sf_dir).join(to_hash(changes).select("path"), "path", "left_semi")


def index_upsert_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next index state: unchanged rows and the fresh hashes that succeeded."""
    changes = index_changes_media(spark, sf_dir)
    return update_index(fixtures.index_before(spark, sf_dir), changes, _fresh_hashes(spark, sf_dir, changes))


def index_failed_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: changed files that could not be hashed in this run."""
    return failed_count(_fresh_hashes(spark, sf_dir, index_changes_media(spark, sf_dir)))


def undo_plan_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undo plan over a listing with group-prefixed names."""
    return undo_plan(fixtures.undo_listing(spark, sf_dir), key="event_id")


def undo_counts_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the undo plan."""
    return outcome_counts(undo_plan_media(spark, sf_dir))


def registry() -> dict[str, Query]:
    q: dict[str, Query] = {
        "fp_embed_median": fp_embed,
        "fp_docs_simhash": fp_docs,
        "fp_grid_ahash": _grid_query("ahash"),
        "fp_grid_dhash": _grid_query("dhash"),
        "fp_grid_whash": _grid_query("whash"),
        "fp_grid_phash": _grid_query("phash"),
        "fp_grid16_whash": fp_grid16_whash,
        "fp_grid32_phash": fp_grid32_phash,
        "hash_hex_roundtrip": hash_hex_roundtrip,
        "resample_embed": resample_embed,
    }
    for t in (18, 20, 22):
        q[f"hamming_pairs_embed_t{t}"] = pairs_query(fp_embed, t)
    for t in (3, 5, 8):
        q[f"hamming_pairs_docs_t{t}"] = pairs_query(fp_docs, t)
    q["hamming_pairs_blank_docs_t5"] = pairs_query(fp_blank_docs, 5)
    q["neighbours_embed_t20"] = neighbours_embed(20)
    q["closest_non_duplicates_embed_t20"] = closest_embed(20)
    q["hamming_pairs_docs_delta_t5"] = hamming_pairs_docs_delta_t5
    q["closest10_docs"] = closest10_docs
    q["closest10_embed"] = closest10_embed
    q["hash_stats_docs"] = hash_stats_docs
    q["exact_duplicates_docs"] = exact_duplicates_docs
    for t in (5, 8):
        q[f"dup_groups_docs_t{t}"] = groups_query(fp_docs, t)
    for t in (18, 20, 22):
        q[f"dup_groups_embed_t{t}"] = groups_query(fp_embed, t)
    q["group_sizes_docs_t5"] = group_sizes_docs_t5
    q["pair_labels_embed_t22"] = pair_labels_embed_t22
    q["listing_media"] = listing_media
    q["capture_time_media"] = capture_time_media
    for name, kw in ORGANISE_CASES.items():
        q[name] = _organise(kw)
    for name in ("organise_rename_inplace", "organise_convert_jpg_rename"):
        short = name.removeprefix("organise_")
        q[f"status_histogram_{short}"] = _summary(q[name], status_histogram)
        q[f"size_totals_{short}"] = _summary(q[name], size_totals)
    q["index_changes_media"] = index_changes_media
    q["index_run_counts_media"] = index_run_counts_media
    q["rename_plan_embed_t20"] = rename_plan_embed(20)
    q["rename_counts_embed_t20"] = rename_counts_embed(20)
    q["rename_plan_docs_t5"] = rename_plan_docs_t5
    q["index_upsert_media"] = index_upsert_media
    q["index_failed_media"] = index_failed_media
    q["undo_plan_media"] = undo_plan_media
    q["undo_counts_media"] = undo_counts_media
    return q
