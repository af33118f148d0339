"""Queries of the near-duplicate join and substring dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.llm.ngram_join import jaccard_classes
from dyadic.llm.registry import query
from dyadic.llm.scan_queries import LOWER
from dyadic.llm.substring_dedup import repeated_words
from dyadic.plans.inputs import table


SPACED = r"[^\x20\x09-\x0D]+"

CLASSES = f"""with recursive d as (select doc_id, regexp_extract_all({LOWER}, '{SPACED}') w from documents),
 sh as materialized (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) end) s from d),
 size as materialized (select doc_id, count(*) n from sh group by 1),
 common as (select l.doc_id a, r.doc_id b, count(*) c from sh l join sh r on l.s = r.s and l.doc_id <> r.doc_id group by 1, 2),
 link as materialized (select a, b from common join size x on x.doc_id = a join size y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
 reach as (select a, b from link union select reach.a, link.b from reach join link on reach.b = link.a)
 select d.doc_id, coalesce(n, 0)::bigint n_shingles, least(d.doc_id, coalesce((select min(b) from reach where a = d.doc_id), d.doc_id)) component_id
 from d left join size using (doc_id)"""

REPEATS = f"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') w from documents),
 win as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) s from (select doc_id, w, unnest(range(1, len(w) - 48)) i from d where len(w) >= 50)),
 firsts as (select s, min(doc_id) f from win group by 1),
 later as (select distinct doc_id, i from win join firsts using (s) where doc_id > f),
 words as (select doc_id, p, w[p] word from (select doc_id, w, unnest(range(1, len(w) + 1)) p from d)),
 marked as (select doc_id, p, word, max(i) over (partition by doc_id order by p rows between 49 preceding and current row) hit
  from words left join (select doc_id, i, i p from later) using (doc_id, p)),
 kept as (select doc_id, count(hit) n_removed, string_agg(word, ' ' order by p) filter (where hit is null) t from marked group by 1)
 select doc_id, len(w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join kept using (doc_id)"""


@query("op3_ngram_join", CLASSES)
def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_classes(table(spark, folder, "documents"), ["doc_id"])
    return found.select("row.doc_id", F.col("n").alias("n_shingles"), F.col("class").alias("component_id"))


@query("op6_substring_dedup", REPEATS)
def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = repeated_words(table(spark, folder, "documents"), ["doc_id"])
    return found.select("row.doc_id", "n_words", "n_removed", F.col("digest").alias("kept_sha256"))
