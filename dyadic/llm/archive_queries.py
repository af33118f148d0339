"""Query of the revisit resolution.

The pages are taken as an archive: each page is a full response, captured in the order of page_id, and is asked again a
while later (for some pages before). The answers are revisits, most with the page's tag, some with another or none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.llm.registry import query
from dyadic.llm.revisits import resolve_revisits
from dyadic.plans.inputs import table


def headers(*pairs):
    fields = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in pairs])
    return F.filter(fields, lambda h: h["value"].isNotNull())


def archive(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the pages: record_id is the page, negative for its revisit."""
    pages = table(spark, folder, "pages").select("page_id", "url", F.md5("html").alias("digest"), F.length("html").cast("string").alias("size"))
    day = F.concat(F.lit("day "), (F.col("page_id") % 365).cast("string"))
    full = pages.select(
        "page_id", "url", (F.col("page_id") * 2).alias("at"), F.lit("response").alias("type"),
        headers(("Content-Type", F.lit("text/html")), ("Content-Length", F.col("size")), ("ETag", F.col("digest")),
                ("Last-Modified", day), ("Cache-Control", F.lit("max-age=60"))).alias("headers"), "digest")
    tag = F.when(F.col("page_id") % 7 == 0, F.lit(None)).when(F.col("page_id") % 7 == 1, "changed").otherwise(F.concat(F.lit("W/"), F.col("digest")))
    late = F.when(F.col("page_id") % 11 == 0, F.col("page_id") * 2 - 1).otherwise(F.col("page_id") * 2 + 201)
    again = pages.select(
        F.expr("-1 - page_id").alias("page_id"), "url", late.alias("at"), F.lit("revisit").alias("type"),
        headers(("Content-Length", F.lit("0")), ("ETag", tag), ("Last-Modified", F.when(F.col("page_id") % 2 == 0, day)),
                ("Cache-Control", F.lit("no-cache"))).alias("headers"), F.lit(None).cast("string").alias("digest"))
    return full.unionByName(again).withColumnRenamed("page_id", "record_id")


REVISITS = r"""with p as (select page_id, md5(html) digest, length(html)::varchar size, 'day ' || (page_id % 365) as day_,
  regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') u from pages),
 c as (select *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '')
  || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') base,
  list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
  lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]*|ref|fbclid|gclid|sessionid)(=|$)'))) q from p),
 k as (select *, base || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end as key_ from c),
 r as (select page_id, key_, case when page_id % 11 = 0 then page_id * 2 - 1 else page_id * 2 + 201 end at_,
  case when page_id % 7 = 0 then null when page_id % 7 = 1 then 'changed' else digest end tag,
  case when page_id % 2 = 0 then day_ end lm from k),
 j as (select r.page_id, max(k.page_id) target from r left join k on r.key_ = k.key_ and k.page_id * 2 < r.at_ group by 1),
 v as (select r.*, j.target, t.digest, t.size, t.day_, coalesce(t.digest = r.tag, t.day_ = r.lm) valid from r join j using (page_id)
  left join k t on t.page_id = j.target),
 s as (select *, case when target is null then 'no_response' when valid is null then 'no_validator' when valid then 'resolved'
  else 'mismatch' end status from v)
 select -1 - page_id record_id, key_ as "key", status, target,
 case when status = 'resolved' then 'Content-Type=text/html&Content-Length=' || size
  || case when tag is null then '&ETag=' || digest else '' end || case when lm is null then '&Last-Modified=' || day_ else '' end
  || case when tag is not null then '&ETag=W/' || tag else '' end || case when lm is not null then '&Last-Modified=' || lm else '' end
  || '&Cache-Control=no-cache' end headers,
 case when status = 'resolved' then digest end digest from s"""


@query("op1_revisits", REVISITS)
def op1_revisits(spark: SparkSession, folder: str) -> DataFrame:
    found = resolve_revisits(archive(spark, folder))
    text = F.array_join(F.transform("headers", lambda h: F.concat_ws("=", h["name"], h["value"])), "&")
    return found.withColumn("headers", text)
