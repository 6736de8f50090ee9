"""Operator 1: resolution of not-modified revisits in web archives, in DataFrame functions only.

A revisit (WARC type ``revisit``, or a response with status 304) has no body.
An as-of join by canonical address finds the latest earlier full response;
entity tag, modification date or payload digest must agree; then the headers
that a 304 may update are merged into the stored ones.

The as-of join has two levels, so that no address ever stands in one task with
all its captures: windows run inside (address, time bucket), and one row per
bucket carries the last full response over to later buckets. Records that can
match nothing, without address or time, are spread over buckets of their own.

Order is (ts, record_id); of records with equal time the smaller id is earlier.
A record without time or address resolves to ``no_response``. Null headers are
empty; header names match without case, the last of repeated names counts.
Revisits without any common validator are ``no_validator``, with a different
one ``validator_mismatch``; only ``resolved`` ones get merged headers. Repeated
rows are resolved each. Bodies never move: the result names the record that
holds the body. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a 304 must not update: hop-by-hop fields and what describes the stored body.
NOT_UPDATED = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Fixed value: query parameters that do not choose a document.
TRACKING = r"^(?:utm_[^=]*|ref|gclid|fbclid|sessionid|phpsessid|jsessionid)(?:=|$)"


def canonical_url(url: Column) -> Column:
    """host/path?query without scheme, www., default port, fragment, tracking parameters and last slash; parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(?:80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def lower_names(headers: Column) -> Column:
    """Header map with lower-case names; of repeated names the last counts."""
    entries = F.map_entries(headers)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))

    def value(name: Column) -> Column:
        return F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == name), -1)["value"]

    return F.when(F.size(entries) > 0, F.map_from_arrays(names, F.transform(names, value))).otherwise(
        F.create_map().cast("map<string,string>")
    )


def verdict(new: Column, old: Column, new_digest: Column, old_digest: Column) -> Column:
    """Agreement of the first validator that both sides have: entity tag (weak comparison), date, digest."""

    def pair(a: Column, b: Column, otherwise: Column) -> Column:
        both = a.isNotNull() & b.isNotNull()
        return F.when(both & (a == b), "resolved").when(both, "validator_mismatch").otherwise(otherwise)

    def tag(headers: Column) -> Column:
        return F.regexp_replace(F.try_element_at(headers, F.lit("etag")), r"^W/", "")

    date = F.lit("last-modified")
    by_digest = pair(new_digest, old_digest, F.lit("no_validator"))
    by_date = pair(F.try_element_at(new, date), F.try_element_at(old, date), by_digest)
    return pair(tag(new), tag(old), by_date)


def resolve(
    records: DataFrame,
    *,
    id_col: str = "record_id",
    url_col: str = "url",
    ts_col: str = "ts",
    type_col: str = "warc_type",
    status_col: str = "status",
    headers_col: str = "headers",
    digest_col: str = "digest",
    bucket_seconds: int = 3_600,
) -> DataFrame:
    """Per revisit: id_col, canonical, ts, verdict, refers_to, refers_ts, digest, headers (merged where resolved)."""
    rows = records.select(
        F.col(id_col).alias("id"), canonical_url(F.col(url_col)).alias("key"), F.col(ts_col).cast("long").alias("ts"),
        F.coalesce((F.lower(type_col) == "revisit") | (F.col(status_col) == 304), F.lit(False)).alias("revisit"),
        F.coalesce((F.lower(type_col) == "response") & (F.col(status_col) == 200), F.lit(False)).alias("full"),
        lower_names(F.col(headers_col)).alias("headers"), F.col(digest_col).alias("digest"),
    ).where("revisit or full")
    nowhere = F.col("key").isNull() | F.col("ts").isNull()
    own = -1 - F.pmod(F.xxhash64("id"), F.lit(1024))
    rows = rows.withColumn("bucket", F.when(nowhere, own).otherwise(F.floor(F.col("ts") / bucket_seconds)))
    stored = F.struct("id", "ts", "headers", "digest")
    usable = F.col("full") & F.col("key").isNotNull() & F.col("ts").isNotNull()

    last = rows.where(usable).groupBy("key", "bucket").agg(F.max_by(stored, F.struct("ts", "id")).alias("last"))
    asked = rows.where("revisit").select("key", "bucket").distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType))
    steps = last.unionByName(asked).groupBy("key", "bucket").agg(F.first("last", ignorenulls=True).alias("last"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.select("key", "bucket", F.last("last", ignorenulls=True).over(before).alias("carried"))

    inside = Window.partitionBy("key", "bucket").orderBy("ts", "id", "full").rowsBetween(Window.unboundedPreceding, -1)
    near = F.last(F.when(usable, stored), ignorenulls=True).over(inside)
    found = rows.withColumn("near", near).where("revisit").join(carried, ["key", "bucket"], "left")
    found = found.withColumn("old", F.coalesce("near", "carried"))
    state = F.when(F.col("old").isNull() | F.col("ts").isNull(), "no_response").otherwise(
        verdict(F.col("headers"), F.col("old.headers"), F.col("digest"), F.col("old.digest"))
    )
    found = found.withColumn("verdict", state)
    update = F.map_filter("headers", lambda k, v: ~k.isin(*NOT_UPDATED))
    merged = F.map_concat(F.map_filter("old.headers", lambda k, v: ~F.map_contains_key(update, k)), update)
    known = F.col("verdict") != "no_response"
    return found.select(
        F.col("id").alias(id_col), F.col("key").alias("canonical"), "ts", "verdict",
        F.when(known, F.col("old.id")).alias("refers_to"), F.when(known, F.col("old.ts")).alias("refers_ts"),
        F.when(F.col("verdict") == "resolved", F.coalesce("old.digest", "digest")).alias("digest"),
        F.when(F.col("verdict") == "resolved", merged).alias("headers"),
    )
