"""Stand-in inputs shaped from the given tables (they do none of a job's work)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imprint.session import read_table


def archive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web-archive records of ``pages``: a full response per page, and a revisit of its URL.

    Every 9th revisit has another entity tag, every 7th none and another date, every 5th neither
    validator; every 11th is an hour before its page's response, every 13th has status 200.
    """
    p = read_table(spark, sf_dir, "pages").select(
        "page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("b")
    )
    day = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 7919 % 2_592_000)
    tag = F.concat(F.lit('"'), F.substring(F.md5("b"), 1, 12), F.lit('"'))
    date = F.date_format(day, "yyyy-MM-dd HH:mm:ss")
    every = lambda n: F.col("page_id") % n == 0
    response = p.select(
        (2 * F.col("page_id")).alias("record_id"), F.lit("response").alias("record_type"), "url",
        day.alias("captured"), F.lit(200).alias("status"),
        F.create_map(
            F.lit("ETag"), tag, F.lit("Last-Modified"), date, F.lit("Date"), date,
            F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length("b").cast("string"),
        ).alias("headers"),
        F.sha1("b").alias("digest"), F.octet_length("b").cast("long").alias("payload_length"),
    )
    late = day + F.when(every(11), F.expr("interval -1 hour")).otherwise(F.expr("interval 5 hour"))
    etag = F.when(every(9), F.lit('"changed"')).when(~every(7) & ~every(5), F.concat(F.lit("W/"), tag))
    modified = F.when(every(7), F.lit("1999-01-01 00:00:00")).when(~every(5), date)
    sent = F.create_map(
        F.lit("etag"), etag, F.lit("last-modified"), modified,
        F.lit("Date"), F.date_format(late, "yyyy-MM-dd HH:mm:ss"),
        F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Content-Length"), F.lit("0"),
    )
    revisit = p.select(
        (2 * F.col("page_id") + 1).alias("record_id"), F.lit("revisit").alias("record_type"),
        F.concat("url", F.lit("#top")).alias("url"), late.alias("captured"),
        F.when(every(13), 200).otherwise(304).alias("status"),
        F.map_filter(sent, lambda k, v: v.isNotNull()).alias("headers"),
        F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("payload_length"),
    )
    return response.unionByName(revisit)
