"""Image listing scan (S1, S2, F1) over a folder, as a DataFrame of file metadata.

``binaryFile`` lists the files; only ``path``, ``modificationTime`` and ``length`` are selected,
so file contents are never read here.  The extension test is case-insensitive (a glob filter
would be case-sensitive and miss ``A.PNG``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imprint.functions.naming import basename, is_image_name


def literal_path(path: str) -> str:
    """A path that names one file or folder, whatever wildcard characters it has."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def list_files(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """Every file of ``directory``: ``(path, name, mtime, size_bytes)``; mtime is naive local time."""
    df = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(literal_path(directory))
        .select("path", "modificationTime", "length")
    )
    return df.select(
        F.col("path"),
        basename("path").alias("name"),
        F.col("modificationTime").cast("timestamp_ntz").alias("mtime"),
        F.col("length").alias("size_bytes"),
    )


def list_images(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """Image files only (F1 on the lower-cased name)."""
    return list_files(spark, directory, recursive).where(is_image_name("name"))


def listed_path(spark: SparkSession, path: str) -> str:
    """A path as the listing spells it: with its file system's scheme and no repeated slashes."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(where).toString()
