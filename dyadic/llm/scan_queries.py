"""Queries of the operators that judge each document where it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.llm.decontamination import contaminated, covered_words, find_contamination
from dyadic.llm.licences import licence_labels, scan_licences
from dyadic.llm.registry import query
from dyadic.plans.inputs import table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = f"""with d as (select doc_id, regexp_extract_all({LOWER}, '{WORD}') w from documents),
 i as (select item_id, w from (select item_id, regexp_extract_all({LOWER}, '{WORD}') w from benchmark) where len(w) > 0),
 win as (select distinct item_id, len(v) k, array_to_string(v, ' ') s from (
  select item_id, unnest(case when len(w) < 13 then [w] else list_transform(range(1, len(w) - 11), lambda p: w[p:p + 12]) end) v from i)),
 sizes as (select distinct k from win),
 grams as (select doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') s from (
  select doc_id, w, k, unnest(range(1, len(w) - k + 2)) p from d, sizes where len(w) >= k)),
 hits as (select doc_id, p, g.k, item_id from grams g join win using (k, s)),
 words as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + k)) q from hits) group by 1),
 its as (select doc_id, count(*) n_items, sha256(string_agg(x, ',' order by x)) h from (
  select distinct doc_id, cast(item_id as varchar) x from hits) group by 1)
 select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
 coalesce(h, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
 from d left join words using (doc_id) left join its using (doc_id)"""


@query("op5_decontamination", DECONTAMINATION)
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])
    n_hit, n_words = covered_words(), F.col("found.n_words")
    return found.select(
        "row.doc_id", "found.n_words", n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("found.items"), ","), 256).alias("items_sha256"),
        contaminated(n_hit, n_words).alias("contaminated"),
    )


@query("op8_licences")
def op8_licences(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licences(table(spark, folder, "documents"), ["doc_id"])
    starts = F.transform("found.places", lambda p: p["start"])
    best = F.array_max(F.transform("found.spans", lambda s: s["coverage"]))
    return found.select(
        "row.doc_id", "found.n_words", F.size("found.places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        licence_labels(F.col("found.places")).alias("base_labels"),
        licence_labels(F.col("found.places"), F.col("found.spans")).alias("labels"),
        F.when(F.size("found.places") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )
