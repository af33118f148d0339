"""Queries over string features, vectors, similarity and neighbour graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadic.functions.hashing import gaussian_matrix
from dyadic.functions.text import (
    char_rows, char_vocabulary, code_point_table, encode_chars, hash_features, ngram_features,
)
from dyadic.functions.vectors import unit
from dyadic.operators.blocks import row_profile
from dyadic.operators.graph import merge_equal, topk_neighbours, with_groups
from dyadic.operators.robustness import column_mask
from dyadic.plans.inputs import ITEMS, gaussian_sql, hash_list, item_data, r9, table
from dyadic.plans.registry import query
from dyadic.predictors.dual_view import lookup_embeddings, missing_embeddings, project, view_similarity
from dyadic.predictors.simple import feature_prior
from dyadic.session import cut_lineage, spread_scan

_CHARS = "ch as (select doc_id, unnest(string_split(text, '')) c from documents), kept as (select * from ch where c <> '')"


@query("char_hash_features", f"""with {_CHARS}, n as (select doc_id, unicode(c) % 16 bucket, count(*) n from kept group by 1, 2)
 select doc_id, cast(bucket as int) bucket, round(n / sqrt(sum(n * n::double) over (partition by doc_id)), 9) w from n""")
def char_hash_features(spark, folder):
    docs = spread_scan(table(spark, folder, "documents").select("doc_id", "text"))
    return hash_features(docs, "doc_id", "text").withColumn("w", r9("w"))


@query("ngram_hash_features", """with t as (select doc_id, string_split(case when length(text) < 2
 then rpad(text, 2, '_') else text end, '') c from documents),
 g as (select doc_id, unnest(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])) g from t),
 n as (select doc_id, ('0x' || substr(md5(g), 1, 8))::bigint % 512 bucket, count(*) n from g group by 1, 2)
 select doc_id, cast(bucket as int) bucket, round(n / sqrt(sum(n * n::double) over (partition by doc_id)), 9) w from n""")
def ngram_hash_features(spark, folder):
    docs = spread_scan(table(spark, folder, "documents").select("doc_id", "text"))
    return ngram_features(docs, "doc_id", "text").withColumn("w", r9("w"))


@query("char_vocab", f"with {_CHARS} select c ch, cast(row_number() over (order by c) as int) id from (select distinct c from kept)")
def char_vocab(spark, folder):
    return char_vocabulary(table(spark, folder, "documents"), "text")


@query("char_encode", """with c as (select distinct c from (select unnest(string_split(p_name, '')) c from part) where c <> ''),
 v as (select list(c order by c) cs from c)
 select p_partkey, array_to_string(list_transform(string_split(p_name, ''), lambda x: list_position(cs, x)), ',') ids from part, v""")
def char_encode(spark, folder):
    names = table(spark, folder, "part").select("p_partkey", "p_name")
    ids = encode_chars("p_name", code_point_table(char_vocabulary(names, "p_name")), None)
    return names.select("p_partkey", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


_POOL_WIDTH, _POOL_SEED = 4, 42


@query("char_mean_pool", f"""with {_CHARS}, n as (select doc_id, c, count(*) n from kept group by 1, 2),
 v as (select c, row_number() over (order by c) id from (select distinct c from kept)), d as (select unnest(range({_POOL_WIDTH})) d),
 e as (select c, d, {gaussian_sql(f"'{_POOL_SEED}|pool|' || id || '|' || d")} w from v, d)
 select doc_id, cast(d as int) dim, round(sum(n * w) / sum(n), 9) as value from n join e using (c) group by doc_id, d""")
def char_mean_pool(spark, folder):
    docs = spread_scan(table(spark, folder, "documents").select("doc_id", "text"))
    vocabulary = cut_lineage(char_vocabulary(docs, "text"))
    ids, size = code_point_table(vocabulary), vocabulary.count()
    weights = gaussian_matrix(_POOL_SEED, "pool", size + 1, _POOL_WIDTH)
    columns = [F.split(F.lit(",".join(repr(row[d]) for row in weights)), ",").cast("array<double>") for d in range(_POOL_WIDTH)]
    counts = char_rows(docs, "doc_id", "text").groupBy("doc_id", F.ascii("ch").alias("cp")).agg(F.count("*").alias("n"))
    token = F.get(ids, F.col("cp"))
    pooled = counts.groupBy("doc_id").agg(
        F.array(*[F.sum(F.col("n") * F.get(c, token)) / F.sum("n") for c in columns]).alias("p")
    )
    return pooled.select("doc_id", F.posexplode("p").alias("dim", "value")).withColumn("value", r9("value"))


@query("column_mask", """with p as (select distinct unnest(range(len(embedding))) position from embeddings),
 r as (select position, row_number() over (order by md5('42|' || position)) rn, count(*) over () d from p)
 select cast(position as int) position, rn <= greatest(1, floor(d * 0.15)) is_masked from r""")
def column_mask_embeddings(spark, folder):
    positions = table(spark, folder, "embeddings").select(
        F.explode(F.sequence(F.lit(0), F.size("embedding") - 1)).alias("position")
    )
    return column_mask(cut_lineage(positions.distinct()), 0.15, 42)


def _unit_embeddings(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("key"), unit(F.col("embedding").cast("array<double>")).alias("vec")
    )


_UNIT = """u as (select cast(vec_id as varchar) k, list_transform(embedding::double[], lambda x: x / nrm) v
 from (select *, sqrt(list_inner_product(embedding::double[], embedding::double[])) nrm from embeddings))"""


@query("cosine_all_pairs", f"""with {_UNIT}, s as (select l.k, r.k o, greatest(0, least(1, list_inner_product(l.v, r.v))) sim from u l, u r)
 select k as key, round(sum(sim), 6) total, round(max(case when o <> k then sim end), 9) best_other from s group by k""")
def cosine_all_pairs(spark, folder):
    """Similarity of all pairs, reported per vector: the total and the best other one."""
    groups = cut_lineage(merge_equal(_unit_embeddings(spark, folder), 2))
    profile = row_profile(groups, groups)
    members = with_groups(_unit_embeddings(spark, folder), groups.select("vec", "id", "n"))
    twin = F.when(F.col("n") > 1, F.lit(1.0)).otherwise(F.col("best_other"))
    return members.join(profile, "id").select("key", r9("total", 6).alias("total"), r9(twin).alias("best_other"))


@query("topk_neighbors", f"""with {_UNIT}, s as (select l.k src, r.k dst, round(greatest(0, least(1, list_inner_product(l.v, r.v))), 9) sim
 from u l, u r where l.k <> r.k), t as (select *, row_number() over (partition by src order by sim desc, dst) rn from s where sim > 0)
 select src, dst, round(sim / sum(sim) over (partition by src), 9) w from t where rn <= 8""")
def topk_neighbors(spark, folder):
    return topk_neighbours(_unit_embeddings(spark, folder), 8).withColumn("w", r9("w"))


_WIDE = """pt as (select p_partkey, count(*) n, unicode(c) bk from (select p_partkey, unnest(string_split(p_name, '')) c from part) group by 1, 3),
 st as (select s_suppkey, count(*) n, unicode(c) bk from (select s_suppkey, unnest(string_split(s_name, '')) c from supplier) group by 1, 3),
 pn as (select cast(p_partkey as varchar) a, bk, n / sqrt(sum(n * n) over (partition by p_partkey)) w from pt),
 sn as (select cast(s_suppkey as varchar) b, bk, n / sqrt(sum(n * n) over (partition by s_suppkey)) w from st),
 dots as (select a, b, sum(pn.w * sn.w) d from pn join sn using (bk) group by 1, 2)"""


@query("cosine_cross_shifted", f"""with {ITEMS}, {_WIDE} select a, b, round(least(1, (coalesce(d, 0) + 1) * 0.5::double), 9) sim
 from items left join dots using (a, b)""")
def cosine_cross_shifted(spark, folder):
    data = item_data(spark, folder, split=False)
    return view_similarity(data, data.pairs.select("a", "b"), {}).select("a", "b", r9("sim").alias("sim"))


_PRIOR = f"""pv as (select p_name, {hash_list('p_name')} v from (select distinct p_name from part)),
 sv as (select s_name, {hash_list('s_name')} v from (select distinct s_name from supplier)),
 mx as (select max(list_inner_product(pv.v, sv.v)) top from pv, sv),
 av as (select cast(p_partkey as varchar) a, v from part join pv using (p_name)),
 bv as (select cast(s_suppkey as varchar) b, v from supplier join sv using (s_name))"""


@query("feature_prior", f"""with {ITEMS}, {_PRIOR} select a, b, round(list_inner_product(av.v, bv.v) / top, 9) prior
 from items join av using (a) join bv using (b), mx""")
def feature_prior_items(spark, folder):
    data = item_data(spark, folder, split=False)
    return feature_prior(data, data.pairs.select("a", "b")).select("a", "b", r9("prior").alias("prior"))


@query("random_projection", f"""with d as (select vec_id, unnest(range(16)) o, embedding::double[] v from embeddings),
 m as (select o, list({gaussian_sql("'42|left|' || o || '|' || i")} / 8.0::double order by i) w
 from (select unnest(range(16)) o), (select unnest(range(64)) i) group by o)
 select vec_id, cast(o as int) dim, round(list_inner_product(v, w), 9) as value from d join m using (o)""")
def random_projection(spark, folder):
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vec"))
    return project(vectors, 42, "left", 64, 16).select(
        F.col("key").alias("vec_id"), F.posexplode("vec").alias("dim", "value")
    ).withColumn("value", r9("value"))


def _document_entities(spark, folder):
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("key"), F.concat("source", F.lit(" "), "lang").alias("content")
    )


@query("embed_lookup_fallback", f"""with d as (select cast(doc_id as varchar) key, source || ' ' || lang content, embedding::double[] e
 from documents left join embeddings on vec_id = doc_id), v as (select key, e is null is_missing,
 coalesce(e, {hash_list('content', 64)}) v from d) select key, is_missing, cast(i - 1 as int) dim, round(v[i], 9) as value
 from (select *, unnest(range(1, 65)) i from v)""")
def embed_lookup_fallback(spark, folder):
    found = lookup_embeddings(_document_entities(spark, folder), table(spark, folder, "embeddings"), 64, "vec_id")
    return found.select("key", "is_missing", F.posexplode("vec").alias("dim", "value")).withColumn("value", r9("value"))


@query("embed_missing_anti", """select cast(doc_id as varchar) key, source || ' ' || lang content from documents
 where doc_id not in (select vec_id from embeddings)""")
def embed_missing_anti(spark, folder):
    return missing_embeddings(_document_entities(spark, folder), table(spark, folder, "embeddings"), "vec_id")
