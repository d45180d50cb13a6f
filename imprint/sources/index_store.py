"""Versioned index on shared storage.

Layout under ``base``: one parquet folder per write with a name of its own, and pointer files
``_CURRENT.<n>`` that each name the folders of a version, oldest first; the highest ``n`` is
live.  A path's row in a later folder replaces earlier ones, and a row without a hash removes it,
so a stream appends small folders and ``compact_index`` makes them one again.  A write fills a new folder
and only then creates a pointer, under a number that no file has, failing if another writer was
first: a reader never sees a half-written index or a missing pointer (an empty pointer of a writer
that died between the two steps is passed over), and what a crash left behind stands in nobody's
way.  Each row records the hash method and format version.

A folder is bucketed by ``path``: the number of buckets is part of its name, and it is read as a
table that declares them, so a join on ``path`` (reconciliation, J1/J2) shuffles only the other
side, whatever the size of the index.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT_VERSION = 1
INDEX_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("mtime", T.TimestampNTZType()),
        T.StructField("h", T.LongType()),
        T.StructField("hash_func", T.StringType()),
        T.StructField("format_version", T.IntegerType()),
    ]
)


def file_system(spark: SparkSession, base: str):
    """(Hadoop file system of a path, JVM)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(conf), jvm


POINTER = "_CURRENT."
_COLUMNS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in INDEX_SCHEMA)
_LOST = re.compile("PATH_NOT_FOUND|FAILED_READ_FILE|CANNOT_READ_FILE_FOOTER")
_DENIED = re.compile("AccessControlException|AccessDenied|Permission denied")


def _pointers(spark: SparkSession, base: str) -> list[int]:
    fs, jvm = file_system(spark, base)
    root = jvm.org.apache.hadoop.fs.Path(base)
    if not fs.exists(root):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(root)]
    return sorted(int(n.removeprefix(POINTER)) for n in names if n.startswith(POINTER) and n.removeprefix(POINTER).isdigit())


def _folders(spark: SparkSession, base: str, number: int) -> list[str]:
    """The folders that a pointer names, oldest first."""
    fs, jvm = file_system(spark, base)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{base}/{POINTER}{number}"))
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
    finally:
        stream.close()


def _current(spark: SparkSession, base: str) -> tuple[int, list[str]]:
    """(highest pointer number, folders of the live version); (0, []) if there is none."""
    numbers = _pointers(spark, base)
    for n in reversed(numbers):
        if folders := _folders(spark, base, n):
            return numbers[-1], folders
    return (numbers[-1] if numbers else 0), []


def _table(spark: SparkSession, base: str, folder: str) -> DataFrame:
    """One folder of the index, with its buckets if its name has them."""
    buckets = re.search(r"-b(\d+)$", folder)
    if not buckets:
        return spark.read.schema(INDEX_SCHEMA).parquet(f"{base}/{folder}")
    fs, jvm = file_system(spark, base)
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{base}/{folder}")):
        spark.read.parquet(f"{base}/{folder}")  # raises that the path is missing
    name = "imprint_" + re.sub(r"\W", "_", folder)
    place = f"{base}/{folder}".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({_COLUMNS}) USING parquet "
        f"CLUSTERED BY (path) SORTED BY (path) INTO {buckets[1]} BUCKETS LOCATION '{place}'"
    )
    spark.catalog.refreshTable(name)
    return spark.table(name)


def read_index(
    spark: SparkSession, base: str, hash_func: str = "phash", strict: bool = False, verify: bool = False
) -> DataFrame:
    """The live index, or an empty one when there is none, its files are missing or corrupt,
    or it was made by another hash method or format (then the caller rebuilds).  Any other
    failure, such as a denied permission, is raised; if ``strict``, for callers that do not
    rebuild, missing and corrupt files are too.  The footers of all files are read to find out, in
    one job; ``verify`` reads every page of them, so damaged data behind good footers is found too."""
    empty = spark.createDataFrame([], INDEX_SCHEMA)
    _, folders = _current(spark, base)
    if not folders:
        return empty
    try:
        parts = [_table(spark, base, f) for f in folders]
        every = reduce(DataFrame.unionByName, parts)
        every.agg(F.bit_xor(F.xxhash64(*INDEX_SCHEMA.names))).first() if verify else every.count()
    except (PySparkException, Py4JJavaError) as e:
        if strict or not _LOST.search(str(e)) or _DENIED.search(str(e)):
            raise
        return empty
    df = parts[0]
    if len(parts) > 1:
        rows = [p.select(F.struct(*INDEX_SCHEMA.names).alias("row"), F.lit(n).alias("n")) for n, p in enumerate(parts)]
        every = reduce(DataFrame.unionByName, rows)
        df = every.groupBy("row.path").agg(F.max_by("row", "n").alias("row")).select("row.*")
    good = (F.col("hash_func") == hash_func) & (F.col("format_version") == FORMAT_VERSION)
    return df.where(good & F.col("h").isNotNull())


def _publish(index: DataFrame, base: str, hash_func: str, after: bool, buckets: int | None = None) -> int:
    """Write ``(path, mtime, h)`` to a folder of its own and point to it, alone or ``after`` the
    folders of the live version; returns the new version's number."""
    spark = index.sparkSession
    out = index.select(
        "path",
        F.col("mtime").cast("timestamp_ntz").alias("mtime"),
        "h",
        F.lit(hash_func).alias("hash_func"),
        F.lit(FORMAT_VERSION).alias("format_version"),
    )
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"index-{uuid.uuid4().hex}-b{n}"
    name = f"imprint_write_{uuid.uuid4().hex}"
    # one file for each bucket: Spark's hash partitions are its buckets
    writer = out.repartition(n, "path").write.mode("errorifexists").format("parquet").bucketBy(n, "path").sortBy("path")
    writer.option("path", f"{base}/{folder}").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    fs, jvm = file_system(spark, base)
    version, folders = _current(spark, base)
    version += 1
    try:  # an exclusive create, also where renames replace files
        stream = fs.create(jvm.org.apache.hadoop.fs.Path(f"{base}/{POINTER}{version}"), False)
    except Py4JJavaError as e:
        raise RuntimeError(f"another writer made version {version} of {base}") from e
    try:
        stream.write("\n".join([*(folders if after else []), folder]).encode())
    finally:
        stream.close()
    return version


def write_index(index: DataFrame, base: str, hash_func: str = "phash", buckets: int | None = None) -> int:
    """Write ``(path, mtime, h)`` as the next version; returns its number.

    Deletions-only runs are written too (the new version simply has fewer rows).  ``buckets`` is
    the number of files, by default the session's shuffle partitions.
    """
    return _publish(index, base, hash_func, after=False, buckets=buckets)


def append_index(changed: DataFrame, base: str, hash_func: str = "phash") -> int:
    """Write only ``changed(path, mtime, h)`` rows, one per path, as a new version on top of the
    live one; a NULL hash removes the path.  Raises if a folder of the live version can't be read."""
    read_index(changed.sparkSession, base, hash_func, strict=True)
    return _publish(changed, base, hash_func, after=True)


def compact_index(spark: SparkSession, base: str, hash_func: str = "phash") -> int:
    """Rewrite the live version as one folder.  Raises if one of its folders can't be read."""
    return write_index(read_index(spark, base, hash_func, strict=True), base, hash_func)


def retain_index(spark: SparkSession, base: str, versions: int = 2) -> list[str]:
    """Delete the pointers before the last ``versions`` and the folders that no pointer left names;
    returns the folders.  To be run when no older version is being read and no write is under way."""
    if versions < 1:
        raise ValueError("the live version stays")
    fs, jvm = file_system(spark, base)
    numbers = _pointers(spark, base)
    live = [n for n in numbers if _folders(spark, base, n)][-versions:]
    used = {f for n in live for f in _folders(spark, base, n)}
    for n in numbers:
        if live and n < live[0]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{base}/{POINTER}{n}"), False)
    names = [f.getPath().getName() for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(base))] if numbers else []
    gone = sorted(n for n in names if n.startswith("index-") and n not in used)
    for folder in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{base}/{folder}"), True)
    return gone
