"""Queries of the operators written in DataFrame functions alone."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.llm import secrets
from dyadic.llm.line_dedup import dedup_lines
from dyadic.llm.mixing import mix_sources
from dyadic.llm.registry import query
from dyadic.llm.secrets import named, scan_secrets
from dyadic.plans.inputs import table

LINES = """with d as (select doc_id, string_split(text, chr(10)) w from documents),
 win as (select doc_id, i, array_to_string(w[i:i + 2], chr(10)) s from (select doc_id, w, unnest(range(1, len(w) - 1)) i from d)),
 firsts as (select s, min((doc_id, i)) f from win group by s having count(*) > 1),
 later as (select doc_id, i from win join firsts using (s) where (doc_id, i) <> f),
 gone as (select doc_id, list(distinct q) g from (select doc_id, unnest(range(i, i + 3)) q from later) group by 1)
 select doc_id, coalesce(len(w), 0)::bigint n_lines, coalesce(len(g), 0)::bigint n_removed,
 array_to_string(case when g is null then w else list_filter(w, lambda x, k: not list_contains(g, k)) end, chr(10)) as text
 from d left join gone using (doc_id)"""


@query("op4_line_dedup", LINES)
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_removed", F.col("kept").alias("text"))


@query("op7_source_mixing")
def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select(
        "row.doc_id", "row.source", F.col("tokens").alias("n_tokens"), F.round("weight", 9).alias("weight"), "pass", "place", "exponent", "held")


def either_case(pattern: str) -> str:
    """``(?i:...)`` groups with ASCII letters in both cases spelled out; the other engine would also fold other letters."""
    spell = lambda m: "(?:" + re.sub(r"[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1]) + ")"
    return re.sub(r"\(\?i:((?:[^()]|\([^()]*\))*)\)", spell, pattern)


def secrets_sql() -> str:
    """Matches by marking and splitting, as many sums of lengths; weak parts by an interval join."""
    patterns = [secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.IDENTIFIER, secrets.WEAK, secrets.ENDPOINT]
    found = []
    for rank, pattern in enumerate(patterns):
        p = either_case(pattern).replace("'", "''")
        long = f" and length(regexp_extract(ps[k], '{p}', 2)) >= 6" if rank == 0 else ""
        found.append(f"""select doc_id, {rank} rank, coalesce(list_sum(list_transform(ps[1:k - 1], lambda x: length(x))), 0)::bigint s, length(ps[k]) n from (
  select doc_id, ps, unnest(range(2, len(ps) + 1, 2)) k from (select doc_id, string_split(regexp_replace(t, '({p})', m || '\\1' || m, 'g'), m) ps from d)) where true{long}""")
    kinds = "['" + "','".join(secrets.KINDS) + "'][rank + 1] || ':' || s || ':' || e"
    ranks = lambda names: ", ".join(str(secrets.KINDS.index(n)) for n in names)
    return f"""with d as (select doc_id, replace(coalesce(text, ''), chr(57344), chr(57345)) t, chr(57344) m from documents),
 al as materialized (select doc_id, rank, s, s + n e from ({' union all '.join(found)})),
 near as (select w.doc_id, w.rank, w.s, w.e, bool_or(o.rank in ({ranks(secrets.SECRETS)})) sec, bool_or(o.rank in ({ranks(secrets.IDENTIFIERS)})) ide
  from al w join al o on w.doc_id = o.doc_id and o.rank <> 5 and o.s - w.e <= {secrets.SCOPE} and w.s - o.e <= {secrets.SCOPE} and (o.s <> w.s or o.e <> w.e)
  where w.rank > 2 group by 1, 2, 3, 4),
 linked as (select doc_id, rank, s, e from near where case rank when 4 then ide when 3 then sec else sec and ide end),
 base as (select doc_id, count(*) filter (where rank = 0) a, count(*) filter (where rank = 1) c, count(*) filter (where rank = 2) h,
  string_agg({kinds}, ',' order by s, rank) b from al where rank < 3 group by 1),
 every as (select doc_id, string_agg({kinds}, ',' order by s, rank, e) sp from (select * from al where rank < 3 union all select * from linked) group by 1)
 select doc_id, coalesce(a, 0)::bigint n_assign, coalesce(c, 0)::bigint n_access, coalesce(h, 0)::bigint n_hex, sha256(coalesce(b, '')) base_sha256,
 coalesce(sp, '') spans from d left join base using (doc_id) left join every using (doc_id)"""


@query("op9_secrets", secrets_sql())
def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_secrets(table(spark, folder, "documents"), ["doc_id"])
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
