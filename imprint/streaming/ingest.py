"""Incremental fingerprint ingest with Structured Streaming (optional re-aim of the index build).

New image files arriving in a folder are decoded by the ``image`` file source as a stream; each
micro-batch is hashed (grey + resample in Arrow batches, bits in the JVM or NumPy) and appended
to the versioned index with ``foreachBatch``: rows of the batch replace rows of the same path when
the index is read, and everything else stays as it is.  The file source
remembers which paths it has seen in its checkpoint, so a file is hashed once; modified or
deleted files are the batch reconciliation's job (:mod:`imprint.operators.index`).
"""

from __future__ import annotations

from pyspark.ml.image import ImageSchema
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from imprint.functions.naming import decoded_origin
from imprint.sources.images import hash_files
from imprint.sources.index_store import append_index, compact_index
from imprint.sources.listing import literal_path


def image_stream(spark: SparkSession, directory: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of decoded images: ``(path, width, height, channels, data, ok, mtime)``."""
    r = spark.readStream.format("image").schema(ImageSchema.imageSchema).option("dropInvalid", "false")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    img = r.load(literal_path(directory))
    return img.select(
        decoded_origin("image.origin").alias("path"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
        (F.col("image.width") > 0).alias("ok"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("mtime"),
    )


COMPACT_EVERY = 50  # versions of a stream between two rewrites of the whole index


def upsert_batch(batch: DataFrame, index_base: str, method: str = "phash") -> int:
    """Hash one micro-batch and append its rows to the index; returns the new version.

    Only the batch is written: a file that could not be decoded removes its path's row.  Every
    COMPACT_EVERY-th version the appended folders become one.
    """
    hashed = hash_files(batch, method, keep=("mtime",))
    fresh = hashed.groupBy("path").agg(F.max_by(F.struct("mtime", "h"), "mtime").alias("r"))
    version = append_index(fresh.select("path", "r.mtime", "r.h"), index_base, method)
    return compact_index(batch.sparkSession, index_base, method) if version % COMPACT_EVERY == 0 else version


def start_ingest(
    spark: SparkSession,
    directory: str,
    index_base: str,
    checkpoint: str,
    method: str = "phash",
    available_now: bool = True,
) -> StreamingQuery:
    """Start the ingest; ``available_now`` processes what is there and stops (batch-like)."""
    stream = image_stream(spark, directory)
    writer = (
        stream.writeStream.foreachBatch(lambda df, _epoch: upsert_batch(df, index_base, method))
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
