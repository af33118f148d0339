"""Queries of the operators on terms: divergence of sources and ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dyadic.llm.divergence import source_divergence
from dyadic.llm.lexical_search import rank_documents
from dyadic.llm.registry import query
from dyadic.llm.scan_queries import LOWER, WORD
from dyadic.plans.inputs import table

LETTERS = r"[^\x00-\x60\x7B-\x7F]+"

DIVERGENCE = f"""with d as (select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source,
  regexp_extract_all({LOWER}, '{LETTERS}') w from documents),
 tf as (select id, lang, source, t, count(*) n from (select id, lang, source, unnest(w) t from d) group by all),
 kept as (select lang, t from tf group by all having count(*) >= 30),
 g as (select distinct lang, source from d),
 own as (select lang, source, t, sum(n) n from tf join kept using (lang, t) group by all),
 every as (select g.lang, g.source, t, coalesce(n, 0) n from g join kept using (lang) left join own using (lang, source, t)),
 p as (select lang, source, t, n, 1 + (1000000000 * (n + 5)) // (sum(n) over (partition by lang, source)
  + 5 * count(*) over (partition by lang, source)) p from every),
 whole as (select lang, t, sum(n) n from own group by all),
 q as (select lang, t, 1 + (1000000000 * (n + 5)) // (sum(n) over (partition by lang) + 5 * count(*) over (partition by lang)) q from whole),
 pairs as (select g.lang, g.source, 'pair' part, h.source item, coalesce((select sum(abs(a.p - b.p)) from p a join p b using (lang, t)
  where a.lang = g.lang and a.source = g.source and b.source = h.source), 0) v from g join g h on g.lang = h.lang and g.source <> h.source),
 terms as (select lang, source, 'term' part, t item, p - q v from p join q using (lang, t) where n > 0 and p > q)
 select lang, source, part, item, v::bigint as value, rank::int as rank from (
  select *, row_number() over (partition by lang, source, part order by v desc, item) rank
  from (select * from pairs union all select * from terms)) where part = 'pair' or rank <= 50"""

SEARCH = f"""with d as (select doc_id, regexp_extract_all({LOWER}, '{WORD}') w from documents),
 tot as (select count(*) nd, sum(len(w))::bigint nt from d where len(w) > 0),
 it as (select distinct item_id, unnest(regexp_extract_all({LOWER}, '{WORD}')) t from benchmark),
 tf as (select doc_id, len(w) n, t, count(*) tf from (select doc_id, w, unnest(w) t from d) where t in (select t from it) group by all),
 wt as (select t, floor(1000 * ln((2 * nd + 2)::double / (2 * count(*) + 1)))::bigint wt from tf, tot group by t, nd),
 part as (select doc_id, t, wt * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nt))) v from tf join wt using (t), tot),
 sc as (select item_id, doc_id, sum(v)::bigint score from it join part using (t) group by all having sum(v) > 0)
 select item_id, rank::int as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) rank from sc) where rank <= 10"""


@query("op11_divergence", DIVERGENCE)
def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(table(spark, folder, "documents"))


@query("op12_search", SEARCH)
def op12_search(spark: SparkSession, folder: str) -> DataFrame:
    return rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
