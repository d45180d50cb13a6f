"""Decode images and turn pixels into luma grids for hashing (S3, H7, H1-H5 on files).

Decoding runs in the JVM through Spark's ``image`` source (PNG, JPEG, GIF, BMP, TIFF; bytes in
BGR order).  A file that cannot be decoded is kept as a row with ``ok = false`` (width -1),
never dropped silently.  Grey conversion and resampling run in NumPy over Arrow batches: luma in
bytes, then a separable windowed sinc with fixed-point weights, as two matrix products; the grid
then feeds the fingerprint builders.

Up to EXACT_PATHS wanted files are read by their own paths, so an update decodes exactly the files
that are new or changed.  More (a first build, say) are read as a scan of the folder that is bounded
by the oldest and newest wanted mtime (``modifiedAfter``, ``modifiedBefore``; two scalars to the
driver), and a semi join keeps exactly the wanted paths before they are hashed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from imprint._ship import ship_with_tasks
from imprint.functions.naming import decoded_origin
from imprint.operators.fingerprint import fingerprint
from imprint.sources.listing import literal_path

ship_with_tasks(__name__)

# grid (width, height) each hash method reads
GRID_SIZE = {"phash": (32, 32), "ahash": (8, 8), "dhash": (9, 8), "whash": (64, 64)}
EXACT_PATHS = 10_000  # most paths that are handed to one read
# ITU-R 601 luma weights for R, G, B in 16 bits; lobes and precision of the resampling.
LUMA = (19595, 38470, 7471)
LOBES = 3
PRECISION = 22
ROWS = 256  # rows of an image that are worked on at once


def decode(
    spark: SparkSession, where: str | list[str], modified_after: str | None = None, modified_before: str | None = None
) -> DataFrame:
    """S3: ``(path, width, height, channels, data, ok)`` for every file of a folder, or of a list of
    paths, that the image source sees."""
    r = spark.read.format("image").option("dropInvalid", "false")
    if modified_after:
        r = r.option("modifiedAfter", modified_after)
    if modified_before:
        r = r.option("modifiedBefore", modified_before)
    img = r.load(literal_path(where) if isinstance(where, str) else [literal_path(p) for p in where])
    return img.select(
        decoded_origin("image.origin").alias("path"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
        (F.col("image.width") > 0).alias("ok"),
    )


def resample_weights(n_in: int, n_out: int) -> np.ndarray:
    """Windowed-sinc (Lanczos-3) weights of every input for every output cell, as fixed-point
    integers of PRECISION bits: ``n_out x n_in``.

    Shrinking widens the window by the scale; each output's weights are normalised to one before
    they are rounded.  At equal sizes nothing is resampled.
    """
    if n_in == n_out:
        return np.eye(n_in, dtype=np.int64) << PRECISION
    scale = n_in / n_out
    wide = max(scale, 1.0)
    center = (np.arange(n_out)[:, None] + 0.5) * scale
    x = np.arange(n_in)[None, :]
    first = np.maximum((center - LOBES * wide + 0.5).astype(int), 0)
    last = np.minimum((center + LOBES * wide + 0.5).astype(int), n_in)
    at = (x - center + 0.5) / wide
    w = np.where((x >= first) & (x < last) & (at >= -LOBES) & (at < LOBES), np.sinc(at) * np.sinc(at / LOBES), 0.0)
    w = w / w.sum(axis=1, keepdims=True) * (1 << PRECISION)
    return np.trunc(w + np.where(w < 0, -0.5, 0.5)).astype(np.int64)


def _pass(px: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows of bytes resampled to as many cells as ``weights`` has rows, rounded to bytes.

    The products are integers below 2^53, so the matrix product in doubles is exact.
    """
    out = np.empty((len(px), len(weights)), np.uint8)
    w = weights.T.astype(np.float64)
    for at in range(0, len(px), ROWS):
        total = (px[at : at + ROWS].astype(np.float64) @ w).astype(np.int64) + (1 << (PRECISION - 1))
        out[at : at + ROWS] = np.clip(total >> PRECISION, 0, 255)
    return out


def grey(px: np.ndarray) -> np.ndarray:
    """Luma bytes of ``height x width x channels`` pixels in BGR order."""
    if px.shape[2] < 3:
        return px[:, :, 0]
    b, g, r = (px[:, :, i].astype(np.uint32) for i in range(3))
    return ((r * LUMA[0] + g * LUMA[1] + b * LUMA[2] + (1 << 15)) >> 16).astype(np.uint8)


def resample(bytes_grid: np.ndarray, gw: int, gh: int, known: dict | None = None) -> np.ndarray:
    """A grey picture (rows of bytes) as ``gh x gw`` bytes: along the rows, then along the columns."""
    known = {} if known is None else known
    h, w = bytes_grid.shape
    for size in ((w, gw), (h, gh)):
        if size not in known:
            known[size] = resample_weights(*size)
    if w != gw:
        bytes_grid = _pass(bytes_grid, known[w, gw])
    return _pass(bytes_grid.T, known[h, gh]).T if h != gh else bytes_grid


def luma_grid_numpy(data: bytes, width: int, height: int, channels: int, gw: int, gh: int, known: dict | None = None) -> np.ndarray:
    """Grey and resampled to ``gh`` rows x ``gw`` columns, row by row.

    Pixels are made grey and resampled along the rows in strips, so only a strip and
    ``height x gw`` bytes are held besides the image itself.
    """
    px = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    known = {} if known is None else known
    strips = [resample(grey(px[at : at + ROWS]), gw, len(px[at : at + ROWS]), known) for at in range(0, height, ROWS)]
    return resample(np.concatenate(strips), gw, gh, known).astype(np.float64).reshape(-1)


def _grid_udf(gw: int, gh: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def grid(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        known: dict = {}  # weights of the sizes met in this batch
        for d, w, h, c in zip(data, width, height, channels, strict=True):
            if d is None or w is None or w <= 0 or h <= 0 or len(d) != w * h * c:
                out.append(None)
            else:
                out.append(luma_grid_numpy(bytes(d), int(w), int(h), int(c), gw, gh, known))
        return pd.Series(out, dtype=object)

    # non-deterministic only to keep the optimizer from evaluating it twice (see fingerprint)
    return grid.asNondeterministic()


def resampled(cells: Column | str, width: Column | int, height: Column | int, gw: int, gh: int) -> Column:
    """H7 on a column: an array of ``width x height`` bytes (as integers, row by row) as the
    integers of a ``gw x gh`` grid; NULL where the array is not of that size."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def grid(cells: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for c, w, h in zip(cells, width, height, strict=True):
            fits = c is not None and w > 0 and h > 0 and len(c) == w * h
            picture = np.asarray(c, np.int64).clip(0, 255).astype(np.uint8).reshape(h, w) if fits else None
            out.append(resample(picture, gw, gh, known).astype(np.int32).reshape(-1) if fits else None)
        return pd.Series(out, dtype=object)

    col = F.col(cells) if isinstance(cells, str) else cells
    sizes = [F.lit(x) if isinstance(x, int) else x for x in (width, height)]
    return grid.asNondeterministic()(col, *sizes)


def luma_grid(decoded: DataFrame, method: str = "phash", out: str = "grid") -> DataFrame:
    """H7: add the luma grid ``method`` needs (NULL for undecodable rows)."""
    gw, gh = GRID_SIZE[method]
    udf = _grid_udf(gw, gh)
    return decoded.withColumn(out, udf("data", "width", "height", "channels"))


def hash_files(decoded: DataFrame, method: str = "phash", keep: tuple[str, ...] = ()) -> DataFrame:
    """S3+H7+H1-H5: ``(path, h, ok)`` and the columns ``keep``; ``h`` is NULL where the file could
    not be decoded."""
    g = luma_grid(decoded, method)
    if method == "whash":
        from imprint.operators.fingerprint import whash

        g = g.withColumn("h", whash("grid", side=GRID_SIZE["whash"][0]))
    else:
        g = fingerprint(g, "grid", method, "h")
    return g.select("path", F.when(F.col("ok"), F.col("h")).alias("h"), (F.col("ok") & F.col("h").isNotNull()).alias("ok"), *keep)


def hash_one(spark: SparkSession, path: str, method: str = "phash") -> int:
    """Hash of one image file anywhere; raises ValueError if there is none or it can't be decoded."""
    try:
        row = hash_files(decode(spark, [path]), method).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        row = None
    if row is None or not row["ok"]:
        raise ValueError(f"not an image that can be read: {path}")
    return row["h"]


def decode_wanted(spark: SparkSession, directory: str, wanted: DataFrame) -> DataFrame:
    """Decoded rows of the ``wanted(path, mtime)`` files, and of no other."""
    some = [r["path"] for r in wanted.select("path").limit(EXACT_PATHS + 1).collect()]
    if 0 < len(some) <= EXACT_PATHS:
        try:
            return decode(spark, some)
        except AnalysisException as e:  # a file has gone since it was listed
            if "PATH_NOT_FOUND" not in str(e):
                raise
    oldest, newest = wanted.agg(F.min("mtime"), F.max("mtime")).first()  # two scalars
    if oldest is None:
        return decode(spark, directory).join(wanted.select("path"), "path", "left_semi")
    after, before = pd.Timestamp(oldest) - pd.Timedelta(seconds=1), pd.Timestamp(newest) + pd.Timedelta(seconds=1)
    shape = "%Y-%m-%dT%H:%M:%S"
    scan = decode(spark, directory, after.strftime(shape), before.strftime(shape))
    return scan.join(wanted.select("path"), "path", "left_semi")


def hash_changed(spark: SparkSession, directory: str, wanted: DataFrame, method: str = "phash") -> DataFrame:
    """Hash only the ``wanted(path, mtime)`` files: ``(path, mtime, h, ok)``.

    A wanted file that the image source does not return (HEIC, say) is a failed row.
    """
    if wanted.isEmpty():
        return spark.createDataFrame([], "path string, mtime timestamp_ntz, h bigint, ok boolean")
    hashed = hash_files(decode_wanted(spark, directory, wanted), method)
    return wanted.select("path", "mtime").join(hashed, "path", "left").select(
        "path", "mtime", "h", F.coalesce(F.col("ok"), F.lit(False)).alias("ok")
    )
