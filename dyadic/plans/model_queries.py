"""Queries over predictors and robustness diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadic.operators.least_squares import gram_sums
from dyadic.operators.marginals import attach_marginals
from dyadic.operators.pairs import PairData
from dyadic.operators import robustness
from dyadic.plans.feature_queries import _PRIOR, _WIDE
from dyadic.plans.inputs import (
    DENSE, LABELLED, dense_pairs, folds, gaussian_sql, hash_list, item_data, r9, table,
)
from dyadic.plans.registry import query
from dyadic.predictors import attention, factorization, mixhop, retrieval, simple
from dyadic.predictors.base import hashed
from dyadic.predictors.factory import create_predictor
from dyadic.session import cut_lineage


@query("ols_gram", f"""with {DENSE}, r as (select a, avg(y / 500) rm from dense group by a), c as (select b, avg(y / 500) cm from dense group by b),
 x as (select rm, cm, y / 500 y from dense join r using (a) join c using (b))
 select count(*) n, round(sum(1.0::double), 6) x0_x0, round(sum(rm), 6) x0_x1, round(sum(cm), 6) x0_x2, round(sum(rm * rm), 6) x1_x1,
 round(sum(rm * cm), 6) x1_x2, round(sum(cm * cm), 6) x2_x2, round(sum(y), 6) x0_y, round(sum(rm * y), 6) x1_y, round(sum(cm * y), 6) x2_y from x""")
def ols_gram(spark, folder):
    pairs = cut_lineage(dense_pairs(spark, folder).withColumn("y", F.col("y") / 500))
    design = attach_marginals(PairData(pairs, None, None), pairs)
    sums = gram_sums(design, ["row_mean", "col_mean"], "y")
    return sums.select("n", *[r9(c, 6).alias(c) for c in sums.columns if c != "n"])


MARGINAL = """greatest(0.0, least(1.0, 0.4::double * coalesce(rm, gm) + 0.4::double * coalesce(cm, gm)
 + 0.1::double * gm + 0.1::double * list_inner_product(av.v, bv.v) / top))"""


def simple_sql(pairs: str, out: str) -> str:
    """Marginal baseline trained on ``pairs`` (a, b, y, fold), scored on all of them."""
    return f"""{out}_r as (select a, avg(y) rm from {pairs} where fold = 'train' group by a),
 {out}_c as (select b, avg(y) cm from {pairs} where fold = 'train' group by b),
 {out}_g as (select avg(y) gm from {pairs} where fold = 'train'),
 {out} as (select a, b, {MARGINAL} p
 from {pairs} left join {out}_r using (a) left join {out}_c using (b) join av using (a) join bv using (b), {out}_g, mx)"""


_BASE = f"{LABELLED}, {folds('labelled')}, {_PRIOR}, {simple_sql('folds', 'base')}"


@query("predict_simple", f"with {_BASE} select a, b, round(p, 9) y_hat from base")
def predict_simple(spark, folder):
    return simple.predict(item_data(spark, folder)).scores.select("a", "b", r9("y_hat").alias("y_hat"))


def mixhop_sql(pairs: str, out: str, k: int = 8) -> str:
    """Propagation over the whole grid with per-entity graphs, the plain way."""

    def graph(name, entities, key):
        return f"""{name}v as materialized (select {key} k, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) v from {entities}),
 {name}s as (select l.k src, r.k dst, round(greatest(0, least(1, list_inner_product(l.v, r.v))), 9) sim from {name}v l, {name}v r where l.k <> r.k),
 {name}t as (select *, row_number() over (partition by src order by sim desc, dst) rn from {name}s where sim > 0),
 {name}e as materialized (select src, dst, sim / sum(sim) over (partition by src) w from {name}t where rn <= {k})"""

    def hop(source, name):
        return f"""{name}h as (select src a, b, sum(w * y) y from {source} join {out}ae on dst = a group by 1, 2),
 {name} as materialized (select a, src b, sum(w * y) y from {name}h join {out}be on dst = b group by 1, 2)"""

    return f"""{graph(out + 'a', 'av', 'a')}, {graph(out + 'b', 'bv', 'b')},
 {out}g as (select avg(y) m from {pairs} where fold = 'train'),
 {out}0 as materialized (select av.a, bv.b, coalesce(f.y, m) y from av cross join bv cross join {out}g
 left join (select a, b, y from {pairs} where fold = 'train') f on f.a = av.a and f.b = bv.b),
 {hop(out + '0', out + '1')}, {hop(out + '1', out + '2')},
 {out} as (select p.a, p.b, greatest(0.0, least(1.0, 0.6::double * z.y + 0.3::double * coalesce(o.y, 0) + 0.1::double * coalesce(t.y, 0))) p
 from {pairs} p join {out}0 z using (a, b) left join {out}1 o using (a, b) left join {out}2 t using (a, b))"""


@query("mixhop_predict", f"with {LABELLED}, {folds('labelled')}, {_PRIOR}, {mixhop_sql('folds', 'mx_')} select a, b, round(p, 8) y_hat from mx_")
def mixhop_predict(spark, folder):
    return mixhop.predict(item_data(spark, folder)).scores.select("a", "b", r9("y_hat", 8).alias("y_hat"))


_WIDTH, _SEED, _LR, _EPOCHS = 16, 42, 0.01, 5


def factor_sql(epochs: int, width: int = _WIDTH) -> str:
    """Gradient descent unrolled: one pair of factor tables per epoch."""

    def initial(side, key, source):
        entry = gaussian_sql(f"'{_SEED}|{side}|' || k || '|' || i")
        return (f"{side}0 as materialized (select k, list({entry} * 0.1::double order by i) v from "
                f"(select cast({key} as varchar) k from {source}), (select unnest(range({width})) i) group by k)")

    out = [initial("a", "p_partkey", "part"), initial("b", "s_suppkey", "supplier"),
           "tr as materialized (select a, b, y from folds where fold = 'train')", "nn as (select count(*) n from tr)"]
    for e in range(epochs):
        out.append(f"""er{e} as materialized (select a, b, p.v pv, q.v qv, list_inner_product(p.v, q.v) - y err
 from tr join a{e} p on p.k = a join b{e} q on q.k = b)""")
        for side, other in (("a", "qv"), ("b", "pv")):
            sums = ", ".join(f"sum(err * {other}[{i + 1}])" for i in range(width))
            out.append(f"""{side}{e + 1} as materialized (select k, case when g is null then v else list_transform(list_zip(v, g),
 lambda z: z[1] - {_LR}::double * 2.0 / n * z[2]) end v from {side}{e} left join (select {side} k, list_value({sums}) g from er{e} group by 1)
 using (k), nn)""")
    return ", ".join(out)


def fit_sql(rows: str, columns: list[str], out: str) -> str:
    """Least squares with a constant on up to three columns of ``rows`` (with y), by centred moments and cofactors."""
    n = len(columns)
    moments = [f"sum(({x} - e{i}) * ({z} - e{j})) s{i}{j}" for i, x in enumerate(columns) for j, z in enumerate(columns)]
    moments += [f"sum(({x} - e{i}) * (y - ey)) m{i}" for i, x in enumerate(columns)]

    def determinant(cells):
        if len(cells) == 1:
            return cells[0][0]
        minors = [[row[:j] + row[j + 1:] for row in cells[1:]] for j in range(len(cells))]
        return "(" + " ".join(f"{'-' if j % 2 else '+'} {cells[0][j]} * {determinant(m)}" for j, m in enumerate(minors)) + ")"

    system = [[f"s{i}{j}" for j in range(n)] for i in range(n)]
    betas = []
    for k in range(n):
        replaced = [[f"m{i}" if j == k else system[i][j] for j in range(n)] for i in range(n)]
        betas.append(f"{determinant(replaced)} / {determinant(system)} b{k + 1}")
    return (f"{out}e as (select avg(y) ey, {', '.join(f'avg({x}) e{i}' for i, x in enumerate(columns))} from {rows}), "
            f"{out}m as (select any_value(ey) ey, {', '.join(f'any_value(e{i}) e{i}' for i in range(n))}, {', '.join(moments)} from {rows}, {out}e), {out}b as (select *, {', '.join(betas)} from {out}m), "
            f"{out} as (select *, ey - {' - '.join(f'b{k + 1} * e{k}' for k in range(n))} b0 from {out}b)")


_MF = {"latent_dim": _WIDTH, "lr": _LR, "seed": _SEED}
_SPLIT = f"{LABELLED}, {folds('labelled')}"


@query("mf_gradient_step", f"""with {_SPLIT}, {factor_sql(1)}, f as (select 'a' side, k, v from a1 union all select 'b', k, v from b1)
 select side, k as key, cast(i - 1 as int) dim, round(v[i], 12) as value from (select *, unnest(range(1, {_WIDTH + 1})) i from f)""")
def mf_gradient_step(spark, folder):
    factors, _, _ = factorization.fit(item_data(spark, folder), {**_MF, "epochs": 1})
    return factors.select("side", "key", F.posexplode("vec").alias("dim", "value")).withColumn("value", r9("value", 12))


# Trained predictors run as long and as wide as the models are by default; the bare steps and the search below need not.
_FULL_WIDTH, _FULL_EPOCHS = 32, 100
_TRAINED = f"{_SPLIT}, {factor_sql(_FULL_EPOCHS, _FULL_WIDTH)}"


@query("predict_mf", f"""with {_TRAINED} select a, b, round(1 / (1 + exp(-list_inner_product(p.v, q.v))), 9) y_hat
 from folds join a{_FULL_EPOCHS} p on p.k = a join b{_FULL_EPOCHS} q on q.k = b""")
def predict_mf(spark, folder):
    found = create_predictor({"name": "matrix_factorization"})(item_data(spark, folder))
    return found.scores.select("a", "b", r9("y_hat").alias("y_hat"))


# The fused score is a mix of the other columns while nothing is clipped, so it adds nothing to the fit.
@query("predict_dual_view", f"""with {LABELLED}, {folds('labelled')}, {_WIDE}, rr as (select a, avg(y) rm from folds where fold = 'train' group by a),
 cc as (select b, avg(y) cm from folds where fold = 'train' group by b), gg as (select avg(y) gm from folds where fold = 'train'),
 x as materialized (select a, b, y, fold, least(1, (coalesce(d, 0) + 1) * 0.5::double) sim, coalesce(rm, gm) rm, coalesce(cm, gm) cm
 from folds left join dots using (a, b) left join rr using (a) left join cc using (b), gg), xt as (select * from x where fold = 'train'),
 {fit_sql('xt', ['sim', 'rm', 'cm'], 'fit')} select a, b, round(greatest(0, least(1, b0 + b1 * sim + b2 * rm + b3 * cm)), 6) y_hat from x, fit""")
def predict_dual_view(spark, folder):
    return create_predictor("dual_frozen_backbone")(item_data(spark, folder)).scores.select("a", "b", r9("y_hat", 6).alias("y_hat"))


def _stored(side: str, source: str, key: str, text: str) -> str:
    """Unit vectors of one side: the stored one by key, else the hashed text at the stored width."""
    return f"""{side}r as (select cast({key} as varchar) k, coalesce(e.embedding::double[], {hash_list(text, 64)}) v from {source} left join embeddings e on vec_id = {key}),
 {side}u as materialized (select k, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) v from {side}r)"""


@query("predict_dual_view_stored", f"""with {LABELLED}, {folds('labelled')}, {_stored('p', 'part', 'p_partkey', 'p_name')}, {_stored('s', 'supplier', 's_suppkey', 's_name')},
 rr as (select a, avg(y) rm from folds where fold = 'train' group by a), cc as (select b, avg(y) cm from folds where fold = 'train' group by b),
 gg as (select avg(y) gm from folds where fold = 'train'),
 x as materialized (select a, b, y, fold, greatest(0, least(1, (list_inner_product(pu.v, su.v) + 1) * 0.5::double)) sim, coalesce(rm, gm) rm, coalesce(cm, gm) cm
 from folds join pu on pu.k = a join su on su.k = b left join rr using (a) left join cc using (b), gg), xt as (select * from x where fold = 'train'),
 {fit_sql('xt', ['sim', 'rm', 'cm'], 'fit')} select a, b, round(greatest(0, least(1, b0 + b1 * sim + b2 * rm + b3 * cm)), 6) y_hat from x, fit""")
def predict_dual_view_stored(spark, folder):
    """Dual view over stored vectors; entities without one are hashed at the stored width."""
    stored = table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("key"), "embedding")
    model = {"name": "dual_frozen_backbone", "left_vectors": stored, "right_vectors": stored}
    return create_predictor(model)(item_data(spark, folder)).scores.select("a", "b", r9("y_hat", 6).alias("y_hat"))


def _projected(vector, tag, width):
    weights = [f"list_sum(list_transform(range(16), lambda i: {vector}[i + 1] * w_{tag}[i * {width} + {j + 1}]))" for j in range(width)]
    return f"list_transform(list_value({', '.join(weights)}), lambda x: tanh(x))"


def attention_sql(width: int) -> str:
    """Row-normalised best eight entries of the softmax over both sides."""
    return f"""ww as (select list({gaussian_sql("'42|query|' || i || '|' || j")} * 0.1::double order by i, j) w_q,
 list({gaussian_sql("'42|keys|' || i || '|' || j")} * 0.1::double order by i, j) w_k
 from (select unnest(range(16)) i), (select unnest(range({width})) j)),
 qa as materialized (select a, {_projected('v', 'q', width)} q from av, ww), kb as materialized (select b, {_projected('v', 'k', width)} k from bv, ww),
 lg as materialized (select a, b, list_inner_product(q, k) / sqrt({width}.0::double) x from qa, kb),
 sm as (select a, b, exp(x - max(x) over (partition by a)) er, exp(x - max(x) over (partition by b)) ec from lg),
 aw as (select a, b, 0.5::double * (er / sum(er) over (partition by a) + ec / sum(ec) over (partition by b)) w from sm),
 tk as (select *, row_number() over (partition by a order by round(w, 12) desc, b) rn from aw),
 attn as materialized (select a, b, w / sum(w) over (partition by a) w from tk where rn <= 8)"""


_ATTENTION = attention_sql(_WIDTH)
_ATTENTION_CONFIG = {**_MF, "epochs": _EPOCHS, "top_k": 8}


@query("attention_scores", f"with {_PRIOR}, {_ATTENTION} select a, b, round(w, 8) w from attn")
def attention_scores(spark, folder):
    members, lists = attention.attention_lists(item_data(spark, folder, split=False), _ATTENTION_CONFIG)
    return members.join(lists, "group").select(F.col("key").alias("a"), F.col("dst").alias("b"), r9("w", 8).alias("w"))


@query("topk_attention", f"""with {_PRIOR}, {_ATTENTION} select a, count(*) n_kept, round(sum(w), 6) total from attn group by a""")
def topk_attention(spark, folder):
    members, lists = attention.attention_lists(item_data(spark, folder, split=False), _ATTENTION_CONFIG)
    per_group = lists.groupBy("group").agg(F.count("*").alias("n_kept"), F.sum("w").alias("total"))
    return members.join(per_group, "group").select(F.col("key").alias("a"), "n_kept", r9("total", 6).alias("total"))


@query("predict_cross_attention", f"""with {_TRAINED}, {_PRIOR}, {attention_sql(_FULL_WIDTH)},
 x as materialized (select f.a, f.b, y, fold, 1 / (1 + exp(-list_inner_product(p.v, q.v))) mf, coalesce(w, 0) attn
 from folds f join a{_FULL_EPOCHS} p on p.k = f.a join b{_FULL_EPOCHS} q on q.k = f.b left join attn t on t.a = f.a and t.b = f.b),
 xt as (select * from x where fold = 'train'), {fit_sql('xt', ['mf', 'attn'], 'fit')}
 select a, b, round(greatest(0, least(1, b0 + b1 * mf + b2 * attn)), 6) y_hat from x, fit""")
def predict_cross_attention(spark, folder):
    found = create_predictor({"name": "interaction_cross_attention"})(item_data(spark, folder))
    return found.scores.select("a", "b", r9("y_hat", 6).alias("y_hat"))


def char_encoder_sql(width: int, epochs: int, lr: float = 0.05, l2: float = 1e-5, seed: int = 42) -> str:
    """Gradient descent of the pooled character model unrolled: per epoch both tables, vectors and biases of both sides."""
    sides = {"a": ("part", "p_partkey", "p_name"), "b": ("supplier", "s_suppkey", "s_name")}
    out = ["tr as materialized (select a, b, y from folds where fold = 'train')", "nn as (select count(*) n from tr)"]
    for s, (source, key, text) in sides.items():
        start = gaussian_sql(f"'{seed}|chars-{s}|' || i || '|' || j")
        out.append(f"""c{s} as (select cast({key} as varchar) k, unnest(string_split({text}, '')) c from {source}),
 w{s} as (select c, row_number() over (order by c) i from (select distinct c from c{s} where c <> '')),
 f{s} as materialized (select k, i, count(*) / sum(count(*)) over (partition by k) f from c{s} join w{s} using (c) group by k, i),
 t{s}0 as materialized (select i, list({start} * 0.05::double order by j) t from (select unnest(range((select count(*) + 1 from w{s}))) i), (select unnest(range({width})) j) group by i),
 o{s}0 as materialized (select cast({key} as varchar) k, 0.0::double o from {source})""")
    lists = lambda term: "list_value(" + ", ".join(term(j) for j in range(1, width + 1)) + ")"
    pooled = lambda s, e: f"v{s}{e} as materialized (select k, {lists(lambda j: f'sum(f * t[{j}])')} v from f{s} join t{s}{e} using (i) group by k)"
    score = "1 / (1 + exp(-(list_inner_product(p.v, q.v) + oa.o + ob.o)))"
    both = lambda e: f"join va{e} p on p.k = a join vb{e} q on q.k = b join oa{e} oa on oa.k = a join ob{e} ob on ob.k = b"
    for e in range(epochs):
        out += [pooled("a", e), pooled("b", e), f"er{e} as materialized (select a, b, p.v pv, q.v qv, {score} - y g from tr {both(e)})"]
        for s, other in (("a", "qv"), ("b", "pv")):
            out.append(f"""g{s}{e} as materialized (select {s} k, {lists(lambda j, other=other: f'sum(g * {other}[{j}]) / any_value(n)')} g, sum(g) / any_value(n) h from er{e}, nn group by 1),
 o{s}{e + 1} as materialized (select k, o - {lr}::double * (coalesce(h, 0) + {l2}::double * o) o from o{s}{e} left join g{s}{e} using (k)),
 d{s}{e} as materialized (select i, {lists(lambda j: f'sum(f * g[{j}])')} d from f{s} join g{s}{e} using (k) group by i),
 t{s}{e + 1} as materialized (select i, {lists(lambda j: f't[{j}] - {lr}::double * (coalesce(d[{j}], 0) + {l2}::double * t[{j}])')} t from t{s}{e} left join d{s}{e} using (i))""")
    out += [pooled("a", epochs), pooled("b", epochs)]
    return f"{', '.join(out)} select a, b, round({score}, 9) y_hat from folds {both(epochs)}"


@query("predict_char_encoder", f"with {_SPLIT}, {char_encoder_sql(64, 30)}")
def predict_char_encoder(spark, folder):
    found = create_predictor({"name": "end_to_end_char_encoder"})(item_data(spark, folder))
    return found.scores.select("a", "b", r9("y_hat").alias("y_hat"))


_PERTURBED = """pert as (select a, b, fold, case when ('0x' || substr(md5('42|' || a || '|' || b), 1, 8))::bigint
 / 4294967296.0::double < 0.1::double then 0.0 else y end y from folds)"""


def _perturbed(data: PairData) -> PairData:
    return data.with_pairs(cut_lineage(robustness.perturb(data.pairs, 0.1, 42)))


@query("reliability_score", f"""with {_BASE}, {_PERTURBED}, {simple_sql('pert', 'shaken')}
 select round(1 - least(1, greatest(0, avg(abs(base.p - shaken.p)))), 9) reliability from base join shaken using (a, b)""")
def reliability_score(spark, folder):
    data = item_data(spark, folder)
    base, shaken = simple.predict(data).scores, simple.predict(_perturbed(data)).scores
    return robustness.reliability(base, shaken).select(r9("reliability").alias("reliability"))


_VIEWS = f"{_BASE}, {_PERTURBED}, {simple_sql('pert', 'shaken')}, {mixhop_sql('folds', 'gr_')}, {mixhop_sql('pert', 'gp_')}"
_TERMS = """t as (select avg(pow(s.p - g.p, 2)) t1, avg(pow(sp.p - g.p, 2)) t2, avg(pow(s.p - gp.p, 2)) t3, count(*) n from base s
 join gr_ g using (a, b) join shaken sp using (a, b) join gp_ gp using (a, b))"""


@query("cross_view_agreement", f"""with {_VIEWS}, {_TERMS} select round(t1, 8) mse_seq_graph, round(t2, 8) mse_seqpert_graph,
 round(t3, 8) mse_seq_graphpert, n n_cells, round(t1 + t2 + t3, 8) l_xview, round(1 / (1 + t1 + t2 + t3), 8) causal_score from t""")
def cross_view_agreement(spark, folder):
    found = robustness.cross_view(*_views(spark, folder)[1])
    rounded = ["mse_seq_graph", "mse_seqpert_graph", "mse_seq_graphpert", "l_xview", "causal_score"]
    return found.select("n_cells", *[r9(c, 8).alias(c) for c in rounded])


def _views(spark, folder):
    """The data and its scores: marginal and propagated, of the given pairs and of the perturbed ones."""
    data = item_data(spark, folder)
    data = data.with_pairs(cut_lineage(data.pairs))
    shaken = _perturbed(data)
    return data, [cut_lineage(m.predict(d).scores) for d in (data, shaken) for m in (simple, mixhop)]


def reconstruction_sql(vectors: str, width: int, out: str, seed: int = 42, ratio: float = 0.15) -> str:
    """Masked reconstruction error of the lists ``v`` in ``vectors``: the known columns are eliminated from the scaled
    Gram matrix one by one, and what is left on the diagonal are the squared residuals."""
    masked = robustness.masked_columns(width, ratio)
    steps = [f"""{out}k as (select i, row_number() over (order by md5('{seed}|' || i)) <= {masked} m from (select unnest(range({width})) i)),
 {out}o as materialized (select i, row_number() over (order by m, i) k from (select * from {out}k union all select {width}, false)),
 {out}x as materialized (select list_append(v, 1.0::double) v, row_number() over () rid from {vectors}),
 {out}c as materialized (select k, list(v[i + 1] order by rid) c from {out}x, {out}o group by k),
 {out}f as materialized (select l.k a, r.k b, list_inner_product(l.c, r.c) s from {out}c l, {out}c r),
 {out}d as materialized (select a, greatest(sqrt(s), 1e-150) d from {out}f where a = b),
 {out}0 as materialized (select f.a, f.b, s / p.d / q.d s from {out}f f join {out}d p on p.a = f.a join {out}d q on q.a = f.b)"""]
    known = width + 1 - masked
    for k in range(1, known + 1):
        last = f"{out}{k - 1}"
        steps.append(f"""{out}{k} as materialized (select t.a, t.b, t.s - case when p.s > 1e-10 then l.s * r.s / p.s else 0 end s from {last} t
 join {last} l on l.a = t.a and l.b = {k} join {last} r on r.a = {k} and r.b = t.b, (select s from {last} where a = {k} and b = {k}) p
 where t.a > {k} and t.b > {k})""")
    steps.append(f"""{out} as (select sum(greatest(s, 0) * d * d) / {masked} / (select count(*) from {out}x) loss from {out}{known} join {out}d using (a) where a = b)""")
    return ", ".join(steps)


@query("masked_reconstruction", f"""with vs as (select embedding::double[] v from embeddings), {reconstruction_sql('vs', 64, 'mr')}
 select round(loss, 9) loss, (select count(*) from vs) n_vectors, 9::int n_masked from mr""")
def masked_reconstruction(spark, folder):
    found = robustness.masked_reconstruction(table(spark, folder, "embeddings").select(F.col("embedding").alias("vec")))
    return found.withColumn("loss", r9("loss"))


_SCORED = f"{_BASE}, scored as materialized (select a, b, y, p from folds join base using (a, b))"
_ENVS = """ev as (select a, ntile(4) over (order by md5('42|' || a)) env from (select distinct a from scored)),
 er as (select env, avg(pow(p - y, 2)) mse, count(*) n from scored join ev using (a) group by env),
 irm as (select case when count(*) < 2 then 0 else var_pop(mse) end l_irm, count(*) n_envs_used, sum(n) n_pairs from er)"""
_SWAPS = """ps as (select a, b from scored where y > 0.5),
 ix as (select b, row_number() over (order by b) - 1 i, count(*) over () n from bv),
 sw as (select ps.a, ps.b, ('0x' || substr(md5('42|swap|' || ps.a || '|' || ps.b), 1, 8))::bigint % (n - 1) st, i from ps join ix using (b)),
 s2 as (select sw.a, sw.b, ix.b b_swap from sw join ix on ix.i = st + case when st >= sw.i then 1 else 0 end),
 cf as (select s2.a, s2.b, s2.b_swap, {MARGINAL} p from s2 left join base_r using (a) left join base_c on base_c.b = s2.b_swap
 join av using (a) join bv on bv.b = s2.b_swap, base_g, mx)""".replace("{MARGINAL}", MARGINAL)


def _scored(spark, folder):
    """Known pairs with their scores, the right entities, and the model as a function of cells."""
    data = item_data(spark, folder)
    scores = simple.predict(data).scores
    return cut_lineage(scores.join(data.pairs.select("a", "b", "y"), ["a", "b"])), data.right, _scorer(data)


def _scorer(data):
    return lambda cells: simple.predict(data, cells).scores


@query("env_risk_variance", f"with {_SCORED}, {_ENVS} select round(l_irm, 12) l_irm, n_envs_used, cast(n_pairs as bigint) n_pairs from irm")
def env_risk_variance(spark, folder):
    scored, _, _ = _scored(spark, folder)
    return robustness.risk_variance(scored).withColumn("l_irm", r9("l_irm", 12))


@query("counterfactual_swap", f"with {_SCORED}, {_SWAPS} select a, b, b_swap, round(p, 9) y_hat from cf")
def counterfactual_swap(spark, folder):
    return robustness.counterfactual_swaps(*_scored(spark, folder)).withColumn("y_hat", r9("y_hat"))


_IRM_CF = "ic as (select any_value(l_irm) l_irm, coalesce(avg(p), 0) l_cf, count(p) n_cf_sampled from irm left join cf on true)"


@query("irm_cf_score", f"""with {_SCORED}, {_ENVS}, {_SWAPS}, {_IRM_CF} select round(l_irm, 12) l_irm, round(l_cf, 9) l_cf, n_cf_sampled,
 round(1 / (1 + l_irm + l_cf), 9) irm_cf_score from ic""")
def irm_cf_score(spark, folder):
    found = robustness.swap_and_environment(*_scored(spark, folder))
    return found.select(r9("l_irm", 12).alias("l_irm"), r9("l_cf").alias("l_cf"), "n_cf_sampled", r9("irm_cf_score").alias("irm_cf_score"))


@query("unified_score", f"""with {_VIEWS}, {_TERMS}, scored as materialized (select a, b, y, p from folds join base using (a, b)), {_ENVS}, {_SWAPS}, {_IRM_CF},
 {reconstruction_sql('av', 16, 'ma')}, {reconstruction_sql('bv', 16, 'mb', 43)},
 un as (select *, t1 + t2 + t3 l_xview, ma.loss + mb.loss l_mas, l_irm / greatest(abs(l_irm), 1) li from ic, t, ma, mb),
 lt as (select *, l_xview + l_mas + 0.25::double * l_cf + 2.0::double * li lt from un)
 select round(l_xview, 8) l_xview, round(l_mas, 8) l_mas, round(l_irm, 12) l_irm, round(l_cf, 8) l_cf, round(li, 12) l_irm_normalised,
 round(lt, 8) l_total, round(1 / (1 + greatest(lt, 0)), 8) unified_causal_score from lt""")
def unified_score(spark, folder):
    data, views = _views(spark, folder)
    agreement = robustness.cross_view(*views)
    masked = robustness.reconstruction_score(cut_lineage(hashed(data.left)), cut_lineage(hashed(data.right)))
    scored = views[0].join(data.pairs.select("a", "b", "y"), ["a", "b"])
    losses = robustness.swap_and_environment(cut_lineage(scored), data.right, _scorer(data)).select(
        agreement.select("l_xview").scalar().alias("l_xview"), F.lit(masked["l_mas"]).alias("l_mas"), "l_irm", "l_cf"
    )
    found = robustness.unified(losses, {"lambda_irm": 2.0, "lambda_cf": 0.25})
    digits = {"l_irm": 12, "l_irm_normalised": 12}
    return found.select(*[r9(c, digits.get(c, 8)).alias(c) for c in found.columns])


_TOP = 5
_UNKNOWN = f"""select a, b, rank::int as rank, round(y, 9) y_hat from (select *, row_number() over (partition by a order by round(y, 9) desc, b) rank
 from (select * from cell anti join folds using (a, b))) where rank <= {_TOP}"""


@query("score_top", f"""with {_BASE}, cell as (select av.a, bv.b, {MARGINAL} y from av cross join bv left join base_r using (a)
 left join base_c on base_c.b = bv.b, base_g, mx) {_UNKNOWN}""")
def score_top(spark, folder):
    """The best unmeasured suppliers of every part by the marginal baseline."""
    data = item_data(spark, folder)
    return retrieval.top_unmeasured(data, "simple_baseline", None, _TOP).withColumn("y_hat", r9("y_hat"))


@query("score_top_mf", f"""with {_SPLIT}, {factor_sql(_EPOCHS)}, cell as (select p.k a, q.k b, list_inner_product(p.v, q.v) y from a{_EPOCHS} p, b{_EPOCHS} q)
 select a, b, rank, round(1 / (1 + exp(-y_hat)), 9) y_hat from ({_UNKNOWN})""")
def score_top_mf(spark, folder):
    """The best unmeasured suppliers of every part by trained factors."""
    data = item_data(spark, folder)
    found = create_predictor({"name": "matrix_factorization", **_MF, "epochs": _EPOCHS})(data)
    return retrieval.top_unmeasured(data, "matrix_factorization", found, _TOP).withColumn("y_hat", r9("y_hat"))
