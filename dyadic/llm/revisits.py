"""Resolution of not-modified revisits in web archives.

A revisit record (a 304 answer) has no body. It is resolved by an as-of join: the latest earlier full response of the
same canonical URL, if the validators agree, gives body and headers; headers that a 304 may update are taken from the
revisit.

The as-of join is a running maximum. Time is cut into ``BLOCKS`` equal parts by quantiles, so that the captures of one
URL are handled in that many tasks; the last response of the parts before comes from an aggregate per URL and part.
Bodies are not moved: the result names the response and its digest.

Defined cases: records without URL or time resolve to nothing. A response at the same time is not earlier. Of responses
with the same time the larger id counts. Equal rows are resolved alike. A revisit without any validator that the
response has too is not resolved (``no_validator``). An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 64

# Header fields that a 304 response may update, and query parameters that do not name a resource.
UPDATED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
IGNORED_PARAMETER = r"^(utm_[a-z]*|ref|fbclid|gclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path without a slash at its end, sorted parameters that count;
    scheme and fragment are dropped. Null for null."""
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    plain = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(plain, r"^[^/?]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(IGNORED_PARAMETER)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def header(headers: Column, name: str) -> Column:
    """First value of a field; null if absent. ``headers`` is an array of (name, value)."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), 0)["value"]


def opaque(etag: Column) -> Column:
    """Entity tag for weak comparison."""
    return F.regexp_replace(etag, r"^W/", "")


def validated(old: Column, new: Column) -> Column:
    """True or false by the first validator that both have, null if there is none."""
    same_tag = opaque(header(old, "etag")) == opaque(header(new, "etag"))
    return F.coalesce(same_tag, header(old, "last-modified") == header(new, "last-modified"))


def merged_headers(old: Column, new: Column) -> Column:
    """The response's headers, those that a 304 may update replaced by the revisit's."""
    update = F.filter(new, lambda h: F.lower(h["name"]).isin(UPDATED))
    names = F.transform(update, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(old, lambda h: ~F.array_contains(names, F.lower(h["name"]))), update)


def resolve_revisits(records: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """One row per revisit of ``records`` (record_id, url, at: long, type: response or revisit, headers, digest).

    Columns: record_id, key, status (resolved, mismatch, no_validator, no_response), target (record_id), headers, digest.
    """
    rows = records.where("type in ('response', 'revisit')").select(
        "record_id", canonical_url(F.col("url")).alias("key"), F.col("at").cast("long").alias("at"), "type", "headers", "digest")
    cuts = rows.agg(F.percentile_approx("at", [k / blocks for k in range(1, blocks)], 10_000)).first()[0] or []  # a bounded list
    cuts = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    rows = rows.withColumn("block", F.size(F.filter(cuts, lambda c: c < F.col("at"))))
    full = F.when(F.col("type") == "response", F.struct("at", "record_id", "headers", "digest"))
    known = rows.where("key is not null and at is not null")
    before = Window.partitionBy("key", "block").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    near = known.withColumn("near", F.max(full).over(before)).where("type = 'revisit'")
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = known.groupBy("key", "block").agg(F.max(full).alias("last")).withColumn("far", F.max("last").over(earlier))
    found = near.join(carried.where("far is not null").select("key", "block", "far"), ["key", "block"], "left")
    found = found.select("record_id", "key", "headers", F.coalesce("near", "far").alias("target"))
    lost = rows.where("type = 'revisit' and (key is null or at is null)").select(
        "record_id", "key", "headers", F.lit(None).cast(found.schema["target"].dataType).alias("target"))
    found = found.unionByName(lost).withColumn("valid", validated(F.col("target.headers"), F.col("headers")))
    status = (F.when(F.col("target").isNull(), "no_response").when(F.col("valid").isNull(), "no_validator")
              .when(F.col("valid"), "resolved").otherwise("mismatch"))
    done = found.withColumn("status", status)
    ok = F.col("status") == "resolved"
    return done.select(
        "record_id", "key", "status", F.col("target.record_id").alias("target"),
        F.when(ok, merged_headers(F.col("target.headers"), F.col("headers"))).alias("headers"),
        F.when(ok, F.col("target.digest")).alias("digest"))
