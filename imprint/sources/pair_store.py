"""Pair tables kept beside an index, one for each hash method and threshold.

A state is a folder with the distinct hashes and their pairs, and a pointer that names it, created
exclusively after both tables are complete; the highest pointer that names a whole state is live.
A state that can't be read is passed over, and the caller builds anew.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from imprint.sources.index_store import file_system

HASHES = "h bigint"
PAIRS = "h_a bigint, h_b bigint, distance int"


def _prefix(method: str, threshold: int) -> str:
    return f"_PAIRS.{method}.{threshold}."


def _states(spark: SparkSession, base: str, prefix: str) -> list[int]:
    fs, jvm = file_system(spark, base)
    root = jvm.org.apache.hadoop.fs.Path(base)
    if not fs.exists(root):
        return []
    names = [f.getPath().getName().removeprefix(prefix) for f in fs.listStatus(root) if f.getPath().getName().startswith(prefix)]
    return sorted(int(n) for n in names if n.isdigit())


def read_pairs(spark: SparkSession, base: str, method: str, threshold: int) -> tuple[DataFrame, DataFrame] | None:
    """(hashes, pairs) of the live state, or None."""
    fs, jvm = file_system(spark, base)
    prefix = _prefix(method, threshold)
    for n in reversed(_states(spark, base, prefix)):
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{base}/{prefix}{n}"))
        try:
            folder = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()
        if not folder:
            continue
        try:
            hashes = spark.read.schema(HASHES).parquet(f"{base}/{folder}/hashes")
            pairs = spark.read.schema(PAIRS).parquet(f"{base}/{folder}/pairs")
            hashes.selectExpr("bit_xor(h)").first(), pairs.selectExpr("bit_xor(h_a + h_b)").first()
        except (PySparkException, Py4JJavaError):
            continue
        return hashes, pairs
    return None


def write_pairs(hashes: DataFrame, pairs: DataFrame, base: str, method: str, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Write a state and point to it; returns its (hashes, pairs)."""
    spark = hashes.sparkSession
    folder = f"pairs-{uuid.uuid4().hex}"
    hashes.select("h").write.parquet(f"{base}/{folder}/hashes")
    pairs.select("h_a", "h_b", "distance").write.parquet(f"{base}/{folder}/pairs")
    fs, jvm = file_system(spark, base)
    prefix = _prefix(method, threshold)
    number = max(_states(spark, base, prefix), default=0) + 1
    try:
        stream = fs.create(jvm.org.apache.hadoop.fs.Path(f"{base}/{prefix}{number}"), False)
    except Py4JJavaError as e:
        raise RuntimeError(f"another writer made pair state {number} of {base}") from e
    try:
        stream.write(folder.encode())
    finally:
        stream.close()
    return (
        spark.read.schema(HASHES).parquet(f"{base}/{folder}/hashes"),
        spark.read.schema(PAIRS).parquet(f"{base}/{folder}/pairs"),
    )
