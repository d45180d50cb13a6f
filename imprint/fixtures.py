"""Stand-in inputs derived from the given test tables (the tables hold no image files).

Each function only shapes rows into the schema a job expects; none does any of the job's work.
The same derivations are written in DuckDB SQL in :mod:`imprint.oracle` so both engines see
identical inputs.  Session time zone must be UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imprint.session import cut_lineage, read_table, spread

# Extensions assigned to media rows by event_id % 5, in this order.
MEDIA_EXTENSIONS = [".jpg", ".JPG", ".png", ".heic", ".txt"]


def media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file row per event: a bag of names, EXIF strings, mtime, dimensions and sizes.

    Written once as a table (as a real listing would be a plain scan), so the derivation is not
    re-evaluated inside every expression that reads ``name``.
    """
    return cut_lineage(spread(_media_files(spark, sf_dir)), "media-files")


def _media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "value")
    i = F.col("event_id")
    ts = F.col("ts")
    t1 = F.date_format(ts, "yyyyMMdd_HHmmss")
    t2 = F.date_format(ts, "yyyy-MM-dd")
    t3 = F.date_format(ts, "yyyy-MM-dd_HH-mm-ss")
    t4 = F.date_format(ts, "dd-MM-yyyy HH:mm:ss")
    ex = F.date_format(ts, "yyyy:MM:dd HH:mm:ss")
    k7 = i % 7
    stem = (
        F.when(k7 == 0, F.concat(F.lit("IMG_"), t1))
        .when(k7 == 1, t2)
        .when(k7 == 2, F.concat(F.lit("shot "), t3))
        .when(k7 == 3, t4)
        .when(k7 == 4, F.concat(F.lit("DSC_"), i.cast("string")))
        .when(k7 == 5, F.lit("2024-02-30_10-00-00"))
        .otherwise(F.concat(F.lit("IMG-"), F.date_format(ts, "yyyyMMdd"), F.lit("-WA"), (i % 50).cast("string")))
    )
    ext = F.element_at(F.lit(MEDIA_EXTENSIONS), (i % 5 + 1).cast("int"))
    name = F.concat(stem, ext)
    size = F.round(F.col("value") * 10000).cast("bigint")
    return ev.select(
        i.alias("event_id"),
        name.alias("name"),
        F.when(i % 4 == 0, ex).when(i % 4 == 1, F.lit("0000:00:00 00:00:00")).alias("exif_original"),
        F.when(i % 6 == 0, ex).alias("exif_datetime"),
        F.date_trunc("second", ts).cast("timestamp_ntz").alias("mtime"),
        F.when(i % 23 != 0, (F.lit(400) + (i * 37) % 3600).cast("bigint")).alias("width"),
        (F.lit(300) + (i * 53) % 2700).cast("bigint").alias("height"),
        size.alias("size_bytes"),
        F.expr(
            "case when event_id % 31 <> 0 then (cast(round(value * 10000) as bigint) * (50 + event_id % 60)) div 100 end"
        ).alias("encoded_size"),
    ).withColumn("path", F.concat(F.lit("d"), i.cast("string"), F.lit("/"), F.col("name")))


def media_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older index state of ``media_files``: every 9th file new, every 11th changed, 13th deleted."""
    mf = media_files(spark, sf_dir).select("event_id", "path", "mtime")
    i = F.col("event_id")
    kept = mf.where(i % 9 != 0).select(
        "event_id",
        "path",
        F.when(i % 11 == 0, F.col("mtime") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("mtime")).alias("mtime"),
    )
    gone = mf.where(i % 13 == 0).select(
        (-i).alias("event_id"),
        F.concat(F.lit("d"), (-i).cast("string"), F.lit("/gone.jpg")).alias("path"),
        "mtime",
    )
    return kept.unionByName(gone)


def existing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names already present in the target folder (conflict snapshot)."""
    mf = media_files(spark, sf_dir).select("event_id", "name")
    i = F.col("event_id")
    a = mf.where(i % 17 == 0).select(F.concat(F.lit("group-01-"), F.col("name")).alias("name"))
    b = mf.where(i % 19 == 0).select("name")
    return a.unionByName(b).distinct()


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, vec)`` from ``embeddings``."""
    return spread(read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))


def grid8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, grid)``: the 64 embedding values read as 8 rows x 8 columns, in double."""
    return embedding_vectors(spark, sf_dir).select("id", F.transform("vec", lambda x: x.cast("double")).alias("grid"))


def grid_tiled(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """``(id, grid)`` of ``side x side`` cells: cell (r, c) is value ``(r*5 + c*3 + r*c) % 64``."""
    cells = F.sequence(F.lit(0), F.lit(side * side - 1))

    def cell(k: Column) -> Column:
        r, c = F.floor(k / side), k % side
        return F.element_at(F.col("grid"), ((r * 5 + c * 3 + r * c) % 64 + 1).cast("int"))

    return grid8(spark, sf_dir).select("id", F.transform(cells, cell).alias("grid"))


def grey_pictures(spark: SparkSession, sf_dir: str, width: int, height: int) -> DataFrame:
    """``(id, cells)``: pictures of ``width x height`` bytes; cell (r, c) is ``floor(1000 v) mod 256`` of
    the value ``v`` at ``(r*5 + c*3 + r*c) % 64``."""
    cells = F.sequence(F.lit(0), F.lit(width * height - 1))

    def cell(k: Column) -> Column:
        r, c = F.floor(k / width), k % width
        v = F.element_at(F.col("grid"), ((r * 5 + c * 3 + r * c) % 64 + 1).cast("int"))
        return F.pmod(F.floor(v * 1000), F.lit(256)).cast("int")

    return grid8(spark, sf_dir).select("id", F.transform(cells, cell).alias("cells"))


def grid9x8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, grid)`` 8 rows x 9 columns for dHash: cell (r, c) is value ``(r*9+c) % 64``."""
    g = grid8(spark, sf_dir)
    return g.select(
        "id",
        F.transform(F.sequence(F.lit(0), F.lit(71)), lambda k: F.element_at(F.col("grid"), (k % 64 + 1).cast("int"))).alias(
            "grid"
        ),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def embedding_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File listing for embedding-backed images: ``(id, path)``.

    Most files are ``img/<id>.png``; every 11th is already group-prefixed and every 13th lives
    in another folder, so the rename plan meets all its cases.
    """
    i = F.col("id")
    path = (
        F.when(i % 13 == 0, F.concat(F.lit("other/"), i.cast("string"), F.lit(".png")))
        .when(i % 11 == 0, F.concat(F.lit("img/group-09-"), i.cast("string"), F.lit(".png")))
        .otherwise(F.concat(F.lit("img/"), i.cast("string"), F.lit(".png")))
    )
    return embedding_vectors(spark, sf_dir).select("id", path.alias("path"))


def index_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index ``(path, mtime, h)`` of ``media_prior``; ``h`` stands for any old hash."""
    return media_prior(spark, sf_dir).select("path", "mtime", (F.col("event_id") * 3).alias("h"))


def hashed_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hashing returns for every listed file: ``(path, mtime, h, ok)``, every 10th failed."""
    i = F.col("event_id")
    ok = i % 10 != 0
    return media_files(spark, sf_dir).select("path", "mtime", F.when(ok, i * 7).alias("h"), ok.alias("ok"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, path)`` of a folder ``doc`` with a file per document; every 12th is elsewhere."""
    i = F.col("doc_id")
    folder = F.when(i % 12 == 0, F.lit("old/")).otherwise(F.lit("doc/"))
    return read_table(spark, sf_dir, "documents").select(
        i.alias("id"), F.concat(folder, F.lpad(i.cast("string"), 12, "0"), F.lit(".jpg")).alias("path")
    )


def document_dir_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the ``doc`` folder, with some ``group-01-`` names already there."""
    f = document_files(spark, sf_dir).where(F.col("path").startswith("doc/"))
    own = f.select("id", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    taken = own.where(F.col("id") % 5 == 0).select(F.concat(F.lit("group-01-"), F.col("name")).alias("name"))
    return own.select("name").unionByName(taken).distinct()


def embedding_dir_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot of the ``img`` folder: its files plus some pre-existing ``group-NN-`` names."""
    f = embedding_files(spark, sf_dir)
    own = f.where(F.col("path").startswith("img/")).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    i = F.col("id")
    extra = f.where(i % 7 == 0).select(
        F.concat(F.lit("group-0"), (i % 9 + 1).cast("string"), F.lit("-"), i.cast("string"), F.lit(".png")).alias("name")
    )
    return own.unionByName(extra).distinct()


def undo_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder listing with group-prefixed names: ``(event_id, name)``."""
    mf = media_files(spark, sf_dir)
    i = F.col("event_id")
    name = (
        F.when(i % 5 == 0, F.concat(F.lit("group-"), F.lpad((i % 23).cast("string"), 2, "0"), F.lit("-"), F.col("name")))
        .when(i % 5 == 1, F.concat(F.lit("group-x-"), F.col("name")))
        .otherwise(F.col("name"))
    )
    return mf.select("event_id", name.alias("name"))
