"""Queries over loading, expressions, joins, aggregates, ranking and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadic.functions.numeric import affinity_label, coerce_number, sigmoid
from dyadic.functions.text import normalize_sequence
from dyadic.functions.vectors import masked_mean
from dyadic.operators import binary_metrics, regression_metrics
from dyadic.operators.concordance import concordance
from dyadic.operators.graph import normalize_rows, softmax_rows
from dyadic.operators.marginals import marginal_means
from dyadic.operators.pairs import PairData, densify, entity_index, first_content, grid, last_write, melt_matrix
from dyadic.operators.robustness import perturb, prediction_stats
from dyadic.operators.splits import assign_environments, sample_exact, split_pairs
from dyadic.plans.inputs import (
    DENSE, ITEM_ORDER, ITEM_ORDER_DESC, ITEMS, LABELLED, METRIC_ROWS, SCORE_ROWS, corr_sql, dense_pairs, folds, item_pairs,
    labelled_pairs, metric_rows, parts, r9, score_rows, table,
)
from dyadic.plans.registry import query
from dyadic.predictors.base import labels_look_binary
from dyadic.predictors.mixhop import training_view
from dyadic.reports import most_recent, newest, pivot_predictions
from dyadic.session import cut_lineage, spread_scan
from dyadic.sources.tables import clean_affinity, clean_binary, clean_regression


@query("pairs_load_regression", """with flat as (select cast(user_id as varchar) a, event_type b,
 try_cast(case when event_type = 'error' then props else cast(value as varchar) end as double) y, event_id from events)
 select a, b, arg_max(y, event_id) y from flat where y is not null and isfinite(y) group by 1, 2""")
def pairs_load_regression(spark, folder):
    rows = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("a_id"), F.concat(F.lit("user "), "user_id").alias("a_text"),
        F.col("event_type").alias("b_id"), F.col("event_type").alias("b_text"),
        F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.col("value").cast("string")).alias("y_text"),
        "event_id",
    )
    return clean_regression(rows, ["event_id"]).pairs


@query("pairs_load_aliased", f"""with flat as (select p_name a, s_name b, l_quantity y,
 row_number() over (partition by p_name, s_name order by {ITEM_ORDER_DESC}) rn
 from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey)
 select a, b, case when y <= 1 then trunc(y) when -log10(y * 1e-9::double + 1e-10::double) <= 7.6::double
 then 1.0 else 0.0 end::double y from flat where rn = 1""")
def pairs_load_aliased(spark, folder):
    items = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", *ITEM_ORDER)
    left = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("a_text"))
    right = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("b_text"))
    rows = items.join(left, "l_partkey").join(right, "l_suppkey").select(
        F.col("l_partkey").cast("string").alias("a_id"), "a_text", F.col("l_suppkey").cast("string").alias("b_id"),
        "b_text", F.col("l_quantity").cast("string").alias("y_text"), *ITEM_ORDER,
    )
    return clean_affinity(rows, ITEM_ORDER).pairs


_LABEL_TEXT = """case when l_quantity <= 10 then '0' when l_quantity <= 20 then '1' when l_quantity <= 30 then '0.0'
 when l_quantity <= 40 then '2' else 'x' end"""


@query("pairs_load_binary", f"""with flat as (select l_partkey, l_suppkey, try_cast({_LABEL_TEXT} as double) y,
 {', '.join(ITEM_ORDER)} from lineitem), kept as (select *, row_number() over (partition by l_partkey, l_suppkey
 order by {ITEM_ORDER_DESC}) rn from flat where y in (0.0, 1.0))
 select cast(l_partkey as varchar) a, cast(l_suppkey as varchar) b, y from kept where rn = 1""")
def pairs_load_binary(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_partkey").cast("string").alias("a_id"), F.col("l_partkey").cast("string").alias("a_text"),
        F.col("l_suppkey").cast("string").alias("b_id"), F.col("l_suppkey").cast("string").alias("b_text"),
        F.expr(_LABEL_TEXT).alias("y_text"), *ITEM_ORDER,
    )
    return clean_binary(rows, ITEM_ORDER).pairs


_MIXED = """case event_type when 'error' then props when 'click' then ' ' || cast(value as {s}) || ' '
 when 'view' then 'NaN' else cast(value as {s}) end"""


@query("coerce_numeric", f"select event_id, nullif(try_cast({_MIXED.format(s='varchar')} as double), 'nan'::double) num from events")
def coerce_numeric(spark, folder):
    return table(spark, folder, "events").select("event_id", coerce_number(F.expr(_MIXED.format(s="string"))).alias("num"))


def _label_sql(c):
    return (f"case when {c} <= 1 then cast(trunc({c}) as int) when -log10({c} * 1e-9::double + 1e-10::double) "
            f"<= 7.6::double then 1 else 0 end")


@query("affinity_binarize", f"""select l_orderkey, l_linenumber, l_quantity, {_label_sql('l_quantity')} label_quantity,
 {_label_sql('l_discount')} label_discount from lineitem""")
def affinity_binarize(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", affinity_label("l_quantity").alias("label_quantity"),
        affinity_label("l_discount").alias("label_discount"),
    )


_ODD = """case when event_id % 11 = 0 then {nan} when event_id % 13 = 0 then {inf} when event_id % 17 = 0 then null
 else value end"""


@query("finite_filter", f"""with e as (select event_id, {_ODD.format(nan="'nan'::double", inf="'inf'::double")} y,
 value y_hat from events) select event_id, y, y_hat from e where y is not null and isfinite(y)""")
def finite_filter(spark, folder):
    odd = F.expr(_ODD.format(nan="double('NaN')", inf="double('Infinity')"))
    rows = table(spark, folder, "events").select("event_id", odd.alias("y"), F.col("value").alias("y_hat"))
    return regression_metrics.finite_pairs(rows)


@query("sigmoid_score", """select event_id, round(1 / (1 + exp(-greatest(-50.0::double, least(50.0::double, value - 100)))), 9) p,
 round(1 / (1 + exp(-greatest(-500.0::double, least(500.0::double, value / 50 - 5)))), 9) p_wide from events""")
def sigmoid_score(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", r9(sigmoid(F.col("value") - 100)).alias("p"), r9(sigmoid(F.col("value") / 50 - 5, 500.0)).alias("p_wide")
    )


@query("row_softmax", f"""with {DENSE}, x as (select a, b, exp(greatest(y / 100 - max(y / 100) over (partition by a), -50)) e
 from dense) select a, b, round(e / greatest(sum(e) over (partition by a), 1e-12), 9) p from x""")
def row_softmax(spark, folder):
    rows = dense_pairs(spark, folder).withColumn("logit", F.col("y") / 100)
    return softmax_rows(rows, "a", "logit", "p").select("a", "b", r9("p").alias("p"))


@query("row_normalize", f"""with {DENSE} select a, b, round(y / greatest(sum(y) over (partition by a), 1e-12), 9) w from dense""")
def row_normalize(spark, folder):
    return normalize_rows(dense_pairs(spark, folder), "a", "y", "w").select("a", "b", r9("w").alias("w"))


@query("objective_infer", """with x as (select 'quality' target, quality::double y from labels union all
 select 'quantity', l_quantity from lineitem) select target, case when bool_and(abs(y) <= 1e-8 or abs(y - 1) <= 1e-8 + 1e-5)
 then 'binary_classification' else 'regression' end objective from x group by 1""")
def objective_infer(spark, folder):
    quality = table(spark, folder, "labels").select(F.lit("quality").alias("target"), F.col("quality").cast("double").alias("y"))
    quantity = table(spark, folder, "lineitem").select(F.lit("quantity").alias("target"), F.col("l_quantity").alias("y"))

    def infer(frame, name):
        return labels_look_binary(frame).select(
            F.lit(name).alias("target"),
            F.when(F.col("is_binary"), "binary_classification").otherwise("regression").alias("objective"),
        )

    return infer(quality, "quality").unionByName(infer(quantity, "quantity"))


@query("nonblank_row_count", "select count(*) n_rows, count(*) filter (where trim(text) <> '') n_nonblank from documents")
def nonblank_row_count(spark, folder):
    return table(spark, folder, "documents").agg(
        F.count("*").alias("n_rows"), F.count_if(F.trim("text") != "").alias("n_nonblank")
    )


@query("training_view", f"""with {DENSE}, {folds('dense')}, g as (select avg(y) m from folds where fold = 'train')
 select a, b, round(case when fold = 'train' then y else m end, 9) y from folds, g""")
def training_view_cells(spark, folder):
    pairs = split_pairs(cut_lineage(dense_pairs(spark, folder)))
    return training_view(PairData(pairs, None, None), pairs).select("a", "b", r9("y").alias("y"))


def _users_and_types(spark, folder):
    events = table(spark, folder, "events")
    users = events.select(F.col("user_id").cast("string").alias("key")).distinct()
    return users, events.select(F.col("event_type").alias("key")).distinct()


_GRID = """users as (select distinct cast(user_id as varchar) a from events),
 types as (select distinct event_type b from events)"""
# Many customers have no order of some priority, so cells stay to be filled.
_ORDERS = """buyers as (select distinct cast(c_custkey as varchar) a from customer), kinds as (select distinct o_orderpriority b from orders),
 placed as (select cast(o_custkey as varchar) a, o_orderpriority b, arg_max(o_totalprice, (o_orderkey, o_totalprice)) y from orders group by 1, 2)"""


@query("grid_cross", f"with {_GRID} select a, b from users, types")
def grid_cross(spark, folder):
    return grid(*_users_and_types(spark, folder))


def _dense_grid(spark, folder, fill):
    """All customers by all order priorities, with the total price of the customer's last order of that priority."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("a"), F.col("o_orderpriority").alias("b"), "o_totalprice", "o_orderkey")
    buyers = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("key")).distinct()
    kinds = orders.select(F.col("b").alias("key")).distinct()
    return densify(grid(buyers, kinds), last_write(orders, ["a", "b"], "o_totalprice", ["o_orderkey", "o_totalprice"]), fill)


@query("grid_densify_zero", f"with {_ORDERS} select a, b, coalesce(y, 0.0) y from (select * from buyers, kinds) g left join placed using (a, b)")
def grid_densify_zero(spark, folder):
    return _dense_grid(spark, folder, "zero")


@query("grid_densify_null", f"with {_ORDERS} select a, b, y from (select * from buyers, kinds) g left join placed using (a, b)")
def grid_densify_null(spark, folder):
    return _dense_grid(spark, folder, "null")


@query("pairs_last_write", f"with {ITEMS} select a, b, y from items")
def pairs_last_write(spark, folder):
    return item_pairs(spark, folder)


_CONTENT_ORDER = [*ITEM_ORDER, "l_partkey", "l_returnflag", "l_linestatus"]


@query("entity_first_content", f"""with x as (select cast(l_suppkey as varchar) key, l_returnflag || l_linestatus content,
 row_number() over (partition by l_suppkey order by {', '.join(_CONTENT_ORDER)}) rn from lineitem)
 select key, content from x where rn = 1""")
def entity_first_content(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("text"), *_CONTENT_ORDER
    )
    return first_content(rows, "id", "text", _CONTENT_ORDER)


@query("entity_index", "select cast(p_partkey as varchar) key, cast(row_number() over (order by cast(p_partkey as varchar)) - 1 as int) idx from part")
def entity_index_parts(spark, folder):
    return entity_index(parts(spark, folder))


@query("entity_distinct", "select distinct p_name content from part")
def entity_distinct(spark, folder):
    return parts(spark, folder).select("content").distinct()


@query("entity_counts", "select count(*) n_rows, count(distinct l_partkey) n_left, count(distinct l_suppkey) n_right from lineitem")
def entity_counts(spark, folder):
    return table(spark, folder, "lineitem").agg(
        F.count("*").alias("n_rows"), F.countDistinct("l_partkey").alias("n_left"), F.countDistinct("l_suppkey").alias("n_right")
    )


@query("marginal_means", f"""with {ITEMS} select a, b, round(avg(y), 9) mean_y, count(y) n from items
 group by grouping sets ((a), (b), ())""")
def marginal_means_items(spark, folder):
    return marginal_means(item_pairs(spark, folder)).select("a", "b", r9("mean_y").alias("mean_y"), "n")


@query("prediction_stats", f"""with {METRIC_ROWS} select round(avg(y_hat), 9) mean, round(sqrt(avg(pow(y_hat - e, 2))), 9) std,
 round(min(y_hat), 9) min, round(max(y_hat), 9) max from m, (select avg(y_hat) e from m)""")
def prediction_stats_items(spark, folder):
    return prediction_stats(metric_rows(spark, folder)).select(*[r9(c).alias(c) for c in ("mean", "std", "min", "max")])


@query("metric_mse_rmse", f"with {METRIC_ROWS} select round(avg(pow(y - y_hat, 2)), 6) mse, round(sqrt(avg(pow(y - y_hat, 2))), 6) rmse from m")
def metric_mse_rmse(spark, folder):
    return regression_metrics.linear_metrics(metric_rows(spark, folder)).select(r9("mse", 6).alias("mse"), r9("rmse", 6).alias("rmse"))


@query("metric_pearson", f"with {METRIC_ROWS} select round({corr_sql('m', 'y', 'y_hat')}, 9) pearson")
def metric_pearson(spark, folder):
    return regression_metrics.linear_metrics(metric_rows(spark, folder)).select(r9("pearson").alias("pearson"))


_RANK = "rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double"


@query("rank_average", f"with {METRIC_ROWS} select distinct y_hat, {_RANK.format(c='y_hat')} as rank from m")
def rank_average(spark, folder):
    return regression_metrics.rank_values(metric_rows(spark, folder), "y_hat")


@query("metric_spearman", f"""with {METRIC_ROWS}, r as (select {_RANK.format(c='y')} ry, {_RANK.format(c='y_hat')} rp from m)
 select round({corr_sql('r', 'ry', 'rp')}, 9) spearman""")
def metric_spearman(spark, folder):
    return regression_metrics.spearman(cut_lineage(metric_rows(spark, folder))).select(r9("spearman").alias("spearman"))


# Counts the lower truths below each prediction, level by level of the (few) truth values.
_CI = """lv as (select distinct y lvl from m), pc as (select y, y_hat, count(*) c from m group by 1, 2),
 ps as (select lvl, p.y_hat, sum(case when p.y = lvl then c else 0 end) cl, sum(case when p.y > lvl then c else 0 end) ch
 from pc p, lv group by 1, 2),
 cu as (select *, sum(cl) over (partition by lvl order by y_hat rows unbounded preceding) - cl below from ps),
 ct as (select sum(ch * (below + 0.5::double * cl)) found from cu),
 tt as (select (pow(sum(n)::double, 2) - sum(pow(n::double, 2))) / 2 total from (select y, count(*) n from m group by 1))"""


@query("metric_concordance", f"with {METRIC_ROWS}, {_CI} select round(found / total, 9) ci from ct, tt")
def metric_concordance(spark, folder):
    return concordance(cut_lineage(metric_rows(spark, folder))).select(r9("ci").alias("ci"))


@query("evaluate_regression", f"""with {METRIC_ROWS}, {_CI}, r as (select *, {_RANK.format(c='y')} ry, {_RANK.format(c='y_hat')} rp from m)
 select round(avg(pow(y - y_hat, 2)), 6) mse, round(sqrt(avg(pow(y - y_hat, 2))), 6) rmse, round({corr_sql('r', 'y', 'y_hat')}, 9) pearson,
 round({corr_sql('r', 'ry', 'rp')}, 9) spearman, round(any_value(found / total), 9) ci, count(*) n_evaluated from r, ct, tt""")
def evaluate_regression(spark, folder):
    found = regression_metrics.evaluate_regression(metric_rows(spark, folder))
    return found.select(r9("mse", 6).alias("mse"), r9("rmse", 6).alias("rmse"),
                        *[r9(c).alias(c) for c in ("pearson", "spearman", "ci")], "n_evaluated")


_CONFUSION = """c as (select count(*) filter (where y >= 0.5 and y_hat >= 0.5)::double tp,
 count(*) filter (where y < 0.5 and y_hat >= 0.5)::double fp, count(*) filter (where y < 0.5 and y_hat < 0.5)::double tn,
 count(*) filter (where y >= 0.5 and y_hat < 0.5)::double fn from s),
 q as (select *, (tp + tn) / (tp + tn + fp + fn) accuracy, coalesce(tp / nullif(tp + fp, 0), 0) as precision,
 coalesce(tp / nullif(tp + fn, 0), 0) sensitivity, coalesce(tn / nullif(tn + fp, 0), 0) specificity from c),
 f as (select *, coalesce(2 * precision * sensitivity / nullif(precision + sensitivity, 0), 0) f1 from q)"""
_AUROC = f"""ar as (select *, {_RANK.format(c='y_hat')} rk from s),
 au as (select (sum(case when y >= 0.5 then rk end) - count(*) filter (where y >= 0.5) * (count(*) filter (where y >= 0.5) + 1) / 2.0)
 / (count(*) filter (where y >= 0.5) * count(*) filter (where y < 0.5)) auroc from ar)"""
_AUPRC = """o as (select y, row_number() over w pos, sum(case when y >= 0.5 then 1 else 0 end) over w tp from s
 window w as (order by y_hat desc, md5('0|' || cast(doc_id as varchar)) rows unbounded preceding)),
 ap as (select sum(case when y >= 0.5 then tp::double / pos end) / count(*) filter (where y >= 0.5) auprc from o)"""
_RATES = ["f1", "accuracy", "sensitivity", "specificity", "precision"]


@query("metric_confusion", f"""with {SCORE_ROWS}, {_CONFUSION} select cast(tp as bigint) tp, cast(fp as bigint) fp,
 cast(tn as bigint) tn, cast(fn as bigint) fn, {', '.join(f'round({c}, 9) as {c}' for c in _RATES)} from f""")
def metric_confusion(spark, folder):
    return binary_metrics.confusion(score_rows(spark, folder)).select(
        "tp", "fp", "tn", "fn", *[r9(c).alias(c) for c in _RATES]
    )


@query("metric_auroc", f"with {SCORE_ROWS}, {_AUROC} select round(auroc, 9) auroc from au")
def metric_auroc(spark, folder):
    return binary_metrics.auroc(cut_lineage(score_rows(spark, folder))).select(r9("auroc").alias("auroc"))


@query("metric_auprc", f"with {SCORE_ROWS}, {_AUPRC} select round(auprc, 9) auprc from ap")
def metric_auprc(spark, folder):
    return binary_metrics.auprc(cut_lineage(score_rows(spark, folder)), ["doc_id"]).select(r9("auprc").alias("auprc"))


@query("evaluate_binary", f"""with {SCORE_ROWS}, {_CONFUSION}, {_AUROC}, {_AUPRC} select round(auroc, 9) auroc, round(auprc, 9) auprc,
 {', '.join(f'round({c}, 9) as {c}' for c in _RATES)}, 0.5::double threshold, cast(tp + fp + tn + fn as bigint) n_evaluated,
 cast(tp + fn as bigint) n_positive, cast(tn + fp as bigint) n_negative from f, au, ap""")
def evaluate_binary(spark, folder):
    found = binary_metrics.evaluate_binary(score_rows(spark, folder), ["doc_id"])
    return found.select(*[r9(c).alias(c) for c in ("auroc", "auprc", *_RATES)],
                        "threshold", "n_evaluated", "n_positive", "n_negative")


@query("split_random", f"with {ITEMS}, {folds('items')} select a, b, fold from folds")
def split_random(spark, folder):
    return split_pairs(cut_lineage(item_pairs(spark, folder)), "random").select("a", "b", "fold")


def _cold(key):
    return f"""with {ITEMS}, e as (select {key} k, row_number() over (order by md5('42|' || {key})) rn, count(*) over () n
 from (select distinct {key} from items)) select a, b,
 case when rn <= n - greatest(1, round_even(n * 0.2, 0)) then 'train' else 'test' end fold from items join e on k = {key}"""


@query("split_cold_a", _cold("a"))
def split_cold_a(spark, folder):
    return split_pairs(cut_lineage(item_pairs(spark, folder)), "cold_drug").select("a", "b", "fold")


@query("split_cold_b", _cold("b"))
def split_cold_b(spark, folder):
    return split_pairs(cut_lineage(item_pairs(spark, folder)), "cold_target").select("a", "b", "fold")


@query("sample_exact", f"with {ITEMS} select a, b, y from items order by md5('7|' || a || '|' || b) limit 5000")
def sample_exact_pairs(spark, folder):
    return sample_exact(cut_lineage(item_pairs(spark, folder)), ["a", "b"], 5000, 7)


@query("env_assign", f"with {ITEMS} select a, cast(ntile(4) over (order by md5('42|' || a)) - 1 as int) env from (select distinct a from items)")
def env_assign(spark, folder):
    return assign_environments(cut_lineage(item_pairs(spark, folder).select("a").distinct()), "a", 4, 42)


@query("perturb_pairs", f"""with {LABELLED} select a, b, case when ('0x' || substr(md5('42|' || a || '|' || b), 1, 8))::bigint
 / 4294967296.0::double < 0.1::double then 0.0 else y end y from labelled""")
def perturb_pairs(spark, folder):
    return perturb(labelled_pairs(spark, folder), 0.1, 42)


@query("recent_limit", "select event_id, user_id, event_type from events order by ts desc, event_id desc limit 12")
def recent_limit(spark, folder):
    return most_recent(table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts"), "ts", "event_id", 12).drop("ts")


@query("latest_per_key", "select user_id, arg_max(event_type, event_id) event_type, max(event_id) event_id from events group by 1")
def latest_per_key(spark, folder):
    return newest(table(spark, folder, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id", "event_type")


@query("matrix_melt", """select vec_id as row, cast(i - 1 as int) col, embedding[i] as value from
 (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) i from embeddings)""")
def matrix_melt(spark, folder):
    return melt_matrix(table(spark, folder, "embeddings"), "vec_id", "embedding")


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("predictions_pivot", f"""with {DENSE} select a, {', '.join(
    f"max(case when b = '{t}' then printf('%.6f', y / 500) end) as {t}" for t in _TYPES)} from dense group by a""")
def predictions_pivot(spark, folder):
    return pivot_predictions(dense_pairs(spark, folder).withColumn("y_hat", F.col("y") / 500))


@query("masked_mean_pool", """with v as (select vec_id, label, unnest(range(16)) d, embedding from embeddings)
 select vec_id, cast(d as int) dim, round(list_sum(list_transform([0, 1, 2, 3], lambda t:
 embedding[t * 16 + d + 1]::double * ((label // (1 << t)) % 2))) / greatest(list_sum(list_transform([0, 1, 2, 3],
 lambda t: ((label // (1 << t)) % 2)::double)), 1e-8), 9) as value from v""")
def masked_mean_pool(spark, folder):
    tokens = F.transform(F.array(*[F.lit(t) for t in range(4)]),
                         lambda t: F.slice(F.col("embedding").cast("array<double>"), t * 16 + 1, F.lit(16)))
    mask = F.array(*[(F.shiftright("label", t) % 2).cast("double") for t in range(4)])
    pooled = table(spark, folder, "embeddings").select("vec_id", masked_mean(tokens, mask, 16).alias("p"))
    return pooled.select("vec_id", F.posexplode("p").alias("dim", "value")).withColumn("value", r9("value"))


@query("seq_normalize", r"""with x as (select doc_id, regexp_replace(upper(replace(regexp_replace(text, '^\s+|\s+$', '', 'g'),
 'ß', 'ss')), '[UZOB]', 'X', 'g') t from documents) select doc_id, md5(t) digest, length(t) n from x""")
def seq_normalize(spark, folder):
    sequence = normalize_sequence("text")
    docs = spread_scan(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.md5(sequence).alias("digest"), F.length(sequence).cast("bigint").alias("n"))


@query("content_md5", "select doc_id, md5(text) digest, strlen(text) n_bytes from documents")
def content_md5(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5("text").alias("digest"), F.octet_length("text").cast("bigint").alias("n_bytes"))
