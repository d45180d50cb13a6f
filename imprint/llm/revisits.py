"""Not-modified revisits of a web archive resolved to full responses (operator 1).

A record has an id, a type (``response`` or ``revisit``), a URL, a capture time, an HTTP status,
headers and, for responses, the payload's digest and length.  Each revisit takes the latest
strictly earlier full response of the same canonical URL (an as-of join).  Its validators are
checked: entity tags by weak comparison, else Last-Modified.  A match merges the headers: the
response's, updated by those that a 304 may carry.

The as-of join has no task that holds a whole URL.  Records are range-partitioned on (URL, time,
type, id); within a partition a window carries the last response forward, and only a
partition's first URL can go on from earlier ones, so one row per partition brings the rest.

Outcomes: ``resolved``; ``no_response`` (no earlier full response); ``mismatch`` (the validators
differ); ``unverified`` (no common validator); ``not_304`` (the revisit is no 304).  Only
``resolved`` rows get headers, digest and length; all but ``no_response`` name the response.

Defined results: a null URL or time never matches; records at the same time don't serve each
other; of several responses at one time the largest id serves; repeated revisits give repeated
rows; header names compare without case, the first of equal names counts; null headers are none;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imprint.llm.common import ROW_BITS, partitions, stage

#: Headers by which a 304 updates the stored response.
PERMITTED = (
    "age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning",
)
#: Query parameters that only track visits.
TRACKING = "utm_[a-z]*|gclid|fbclid|sessionid|phpsessid"

COLUMNS = (
    "record_id", "record_type", "url", "captured", "status", "headers", "digest", "payload_length",
)


def canonical_url(url: Column) -> Column:
    """Scheme-less key: host in lower case without ``www.`` and default port, path without a last
    slash, query parameters sorted without tracking ones, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^(?i)https?://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^({TRACKING})(=|$)"))
    line = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(line != "", F.concat(F.lit("?"), line)).otherwise(""))


def _headers(headers: Column) -> Column:
    """The headers as a map with names in lower case; the first of equal names counts."""
    pairs = F.transform(
        F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))),
        lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")),
    )
    names = F.transform(pairs, lambda e: e["key"])
    return F.map_from_entries(F.filter(pairs, lambda e, i: F.array_position(names, e["key"]) == i + 1))


def _validated(revisit: Column, response: Column) -> Column:
    """True or false by the first validator that both carry, null if there is none."""
    tag = lambda h: F.regexp_replace(F.trim(h["etag"]), r"^W/", "")
    day = lambda h: F.trim(h["last-modified"])
    return F.coalesce(tag(revisit) == tag(response), day(revisit) == day(response))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: (record_id, url_key, captured, outcome, response_id, headers, digest,
    payload_length)."""
    rows = records.select(*COLUMNS)
    full = (F.col("record_type") == "response") & (F.col("status") == 200)
    rows = rows.filter(full | (F.col("record_type") == "revisit")).select(
        "record_id", "captured", "status",
        canonical_url(F.col("url")).alias("key"),
        F.coalesce(full, F.lit(False)).alias("full"),
        _headers(F.col("headers")).alias("headers"),
        "digest", "payload_length",
    )
    # at one time revisits come first, so they never see a response of that time
    order = ["key", "captured", "full", "record_id"]
    dealt = rows.withColumn("salt", F.xxhash64("record_id", "digest"))
    dealt = dealt.repartitionByRange(partitions(records), *order, "salt").sortWithinPartitions(*order, "salt")
    t = stage(dealt.drop("salt").withColumn("mid", F.monotonically_increasing_id()), "revisit-order")
    t = t.withColumn("pid", F.shiftright("mid", ROW_BITS))
    usable = F.col("full") & F.col("key").isNotNull() & F.col("captured").isNotNull()
    answer = F.when(usable, F.struct("record_id", "captured", "headers", "digest", "payload_length"))

    own = Window.partitionBy("pid", "key").orderBy("mid").rowsBetween(Window.unboundedPreceding, -1)
    near = t.withColumn("found", F.last(answer, ignorenulls=True).over(own)).filter("not full")

    # what a partition hands on: its last response, for the first URL of a later partition
    last = F.max_by(F.struct("key", answer.alias("answer")), F.when(usable, F.col("mid")))
    ends = t.groupBy("pid").agg(F.min_by("key", "mid").alias("first_key"), last.alias("last"))
    ahead = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("carried", F.last("last", ignorenulls=True).over(ahead))
    ends = ends.filter(F.col("carried.key") == F.col("first_key"))
    ends = ends.select("pid", F.col("first_key").alias("key"), F.col("carried.answer").alias("carried"))
    near = near.join(F.broadcast(ends), ["pid", "key"], "left")
    # equal times: the response must be strictly earlier
    found = F.when(F.col("key").isNotNull() & F.col("captured").isNotNull(), F.coalesce("found", "carried"))
    near = near.withColumn("r", found)

    same = _validated(F.col("headers"), F.col("r.headers"))
    outcome = (
        F.when(F.col("r").isNull(), "no_response")
        .when(~F.coalesce(F.col("status") == 304, F.lit(False)), "not_304")
        .when(same.isNull(), "unverified")
        .when(same, "resolved")
        .otherwise("mismatch")
    )
    near = near.withColumn("outcome", outcome)
    update = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    stored = F.map_filter("r.headers", lambda k, v: ~F.map_contains_key(update, k))
    ok = F.col("outcome") == "resolved"
    return near.select(
        "record_id", F.col("key").alias("url_key"), "captured", "outcome",
        F.col("r.record_id").alias("response_id"),
        F.when(ok, F.map_concat(stored, update)).alias("headers"),
        F.when(ok, F.col("r.digest")).alias("digest"),
        F.when(ok, F.col("r.payload_length")).alias("payload_length"),
    )


def attach_payload(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """Add ``payload`` of the response to resolved revisits; ``payloads`` is (record_id, payload).

    An equi-join of two plain tables: a response that serves very many revisits is split by
    skew handling.
    """
    p = payloads.select(F.col("record_id").alias("_response"), F.col("payload"))
    hit = F.when(F.col("outcome") == "resolved", F.col("response_id")) == F.col("_response")
    return resolved.join(p, hit, "left").drop("_response")


def header_lines(headers: Column) -> Column:
    """Sorted ``name: value`` lines."""
    pairs = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(F.array_sort(pairs), "\n")
