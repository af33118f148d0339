"""Predictors and graphs against small dense numpy formulations of their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadic.functions.hashing import gaussian_matrix
from dyadic.operators import robustness
from dyadic.operators.graph import topk_neighbours
from dyadic.operators.pairs import PairData
from dyadic.operators.skew import find_hot_keys
from dyadic.predictors import attention, char_encoder, dual_view, factorization, mixhop, simple
from dyadic.predictors.factory import create_predictor

LEFT = {"p1": "CCO", "p2": "CCO", "p3": "OCC", "p4": "NNC", "p5": "CNO=", "p6": "CCO"}
RIGHT = {"q1": "MKV", "q2": "VKM", "q3": "MMLA", "q4": "GGAV"}


def histogram(text, width=16):
    v = np.zeros(width)
    for ch in text:
        v[ord(ch) % width] += 1
    return v / np.linalg.norm(v) if v.any() else v


def adjacency(texts, k):
    keys = list(texts)
    x = np.array([histogram(texts[key]) for key in keys])
    sim = np.round(np.clip(x @ x.T, 0, 1), 9)
    out = np.zeros_like(sim)
    k = max(1, min(k, max(1, len(keys) - 1)))
    for i in range(len(keys)):
        order = sorted((j for j in range(len(keys)) if j != i and sim[i, j] > 0), key=lambda j: (-sim[i, j], keys[j]))[:k]
        out[i, order] = sim[i, order]
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-12)


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(3)
    y = np.round(rng.uniform(0, 1, (6, 4)), 2)
    known = rng.uniform(size=(6, 4)) < 0.7
    known[0, 0] = True
    rows = [(a, b, float(y[i, j]), "train" if (i + j) % 4 else "test")
            for i, a in enumerate(LEFT) for j, b in enumerate(RIGHT) if known[i, j]]
    pairs = spark.createDataFrame(rows, "a string, b string, y double, fold string").persist()
    entities = [spark.createDataFrame(list(t.items()), "key string, content string") for t in (LEFT, RIGHT)]
    train = np.full((6, 4), np.nan)
    for a, b, value, fold in rows:
        if fold == "train":
            train[list(LEFT).index(a), list(RIGHT).index(b)] = value
    cells = spark.createDataFrame([(a, b) for a in LEFT for b in RIGHT], "a string, b string")
    return PairData(pairs, *entities), train, cells


def grid_of(scores):
    out = np.full((6, 4), np.nan)
    for r in scores.collect():
        out[list(LEFT).index(r.a), list(RIGHT).index(r.b)] = r.y_hat
    return out


def means(train):
    with np.errstate(all="ignore"):
        g = np.nanmean(train)
        row = np.array([np.nanmean(r) if np.isfinite(r).any() else g for r in train])
        col = np.array([np.nanmean(c) if np.isfinite(c).any() else g for c in train.T])
    return row[:, None], col[None, :], g


def test_simple(world):
    data, train, cells = world
    row, col, g = means(train)
    prior = np.array([histogram(t) for t in LEFT.values()]) @ np.array([histogram(t) for t in RIGHT.values()]).T
    expected = np.clip(0.4 * row + 0.4 * col + 0.1 * g + 0.1 * prior / prior.max(), 0, 1)
    np.testing.assert_allclose(grid_of(simple.predict(data, cells).scores), expected, atol=1e-12)


@pytest.mark.parametrize("k", [1, 2, 8])
def test_mixhop_equals_dense_propagation(world, k):
    data, train, cells = world
    filled = np.where(np.isfinite(train), train, np.nanmean(train))
    a, b = adjacency(LEFT, k), adjacency(RIGHT, k)
    expected = 0.6 * filled + 0.3 * a @ filled @ b.T + 0.1 * a @ a @ filled @ (b @ b).T
    found = grid_of(mixhop.predict(data, cells, {"top_k": k, "objective": "regression"}).scores)
    np.testing.assert_allclose(found, expected, atol=1e-9)


def test_neighbours_with_many_copies_ties_and_several_blocks(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 5))
    pick = np.where(rng.uniform(size=200) < 0.4, 0, rng.integers(0, 40, 200))
    vecs = {f"v{i:03d}": base[p] for i, p in enumerate(pick)}
    keys = list(vecs)
    x = np.array([v / np.linalg.norm(v) for v in vecs.values()])
    sim = np.round(np.clip(x @ x.T, 0, 1), 9)
    frame = spark.createDataFrame([(k, [float(z) for z in v]) for k, v in vecs.items()], "key string, vec array<double>")
    found = {}
    for r in topk_neighbours(frame, 4, block=7).collect():
        found.setdefault(r.src, []).append((r.dst, r.w))
    for i, key in enumerate(keys):
        order = sorted((j for j in range(200) if j != i and sim[i, j] > 0), key=lambda j: (-sim[i, j], keys[j]))[:4]
        assert {d for d, _ in found[key]} == {keys[j] for j in order}
        assert sum(w for _, w in found[key]) == pytest.approx(1.0)
    lonely = spark.createDataFrame([("x", [1.0])], "key string, vec array<double>")
    assert topk_neighbours(lonely, 3).count() == 0


def initial(seed, side, keys, width):
    import hashlib
    import math

    def entry(key, i):
        h = hashlib.md5(f"{seed}|{side}|{key}|{i}".encode()).hexdigest()
        return math.sqrt(-2 * math.log((int(h[:8], 16) + 1) / 2 ** 32)) * math.cos(2 * math.pi * int(h[8:16], 16) / 2 ** 32)

    return 0.1 * np.array([[entry(k, i) for i in range(width)] for k in keys])


def dense_factors(train, width, epochs, lr, seed):
    p, q = initial(seed, "a", LEFT, width), initial(seed, "b", RIGHT, width)
    known, losses = np.isfinite(train), []
    for _ in range(epochs):
        err = np.where(known, p @ q.T - np.nan_to_num(train), 0)
        losses.append(np.sum(err ** 2) / known.sum())
        p, q = p - lr * 2 / known.sum() * err @ q, q - lr * 2 / known.sum() * err.T @ p
    return 1 / (1 + np.exp(-(p @ q.T))), losses


def test_factorisation_follows_dense_descent(world):
    data, train, cells = world
    expected, losses = dense_factors(train, 4, 3, 0.5, 7)
    found = factorization.predict(data, cells, {"latent_dim": 4, "epochs": 3, "lr": 0.5, "seed": 7})
    np.testing.assert_allclose(grid_of(found.scores), expected, atol=1e-12)
    np.testing.assert_allclose(found.loss_history, losses, atol=1e-12)
    assert losses[-1] < losses[0] and found.factors.count() == 10


def softmax(x):
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("block", [2, 100])
def test_attention_lists_equal_dense_attention(world, block):
    data, _, _ = world
    wq, wk = (np.array(gaussian_matrix(42, tag, 16, 4)) * 0.1 for tag in ("query", "keys"))
    q = np.tanh(np.array([histogram(t) for t in LEFT.values()]) @ wq)
    k = np.tanh(np.array([histogram(t) for t in RIGHT.values()]) @ wk)
    logits = q @ k.T / np.sqrt(4.0)
    attn = 0.5 * (softmax(logits) + softmax(logits.T).T)
    members, lists = attention.attention_lists(data, {"latent_dim": 4, "top_k": 2}, block)
    found = np.zeros((6, 4))
    for r in members.join(lists, "group").collect():
        found[list(LEFT).index(r.key), list(RIGHT).index(r.dst)] = r.w
    expected = np.zeros((6, 4))
    for i in range(6):
        best = sorted(range(4), key=lambda j: (-round(attn[i, j], 14), list(RIGHT)[j]))[:2]
        expected[i, best] = attn[i, best] / attn[i, best].sum()
    np.testing.assert_allclose(found, expected, atol=1e-12)


def test_cross_attention_is_calibrated_on_training_pairs(world):
    data, train, cells = world
    found = grid_of(create_predictor({"name": "interaction_cross_attention", "latent_dim": 4, "epochs": 2})(data, cells).scores)
    known = np.isfinite(train)
    assert np.mean(found[known]) == pytest.approx(np.mean(train[known]), abs=1e-9)


def test_dual_view_is_a_least_squares_fit(world):
    data, train, cells = world
    row, col, _ = means(train)
    wide = [np.array([histogram(t, 768) for t in s.values()]) for s in (LEFT, RIGHT)]
    sim = np.clip((wide[0] @ wide[1].T + 1) / 2, 0, 1)
    base = np.clip(0.7 * sim + 0.3 * (0.5 * row + 0.5 * col), 0, 1)
    x = np.stack([np.ones_like(sim), base, sim, row + 0 * sim, col + 0 * sim], axis=-1)
    known = np.isfinite(train)
    beta = np.linalg.lstsq(x[known], train[known], rcond=None)[0]
    found = grid_of(dual_view.predict(data, cells).scores)
    np.testing.assert_allclose(found, np.clip(x @ beta, 0, 1), atol=1e-7)


def test_dual_view_with_vectors_of_different_width(spark, world):
    data, _, cells = world
    left = spark.createDataFrame([(k, [float(i + j) for j in range(5)]) for i, k in enumerate(LEFT) if k != "p2"], "key string, embedding array<double>")
    right = spark.createDataFrame([(k, [float(i * j) + 1 for j in range(3)]) for i, k in enumerate(RIGHT)], "key string, embedding array<double>")
    found = grid_of(dual_view.predict(data, cells, {"left_vectors": left, "right_vectors": right}).scores)
    assert np.isfinite(found).all() and found.min() >= 0 and found.max() <= 1
    missing = dual_view.missing_embeddings(data.left, left)
    assert [r.key for r in missing.collect()] == ["p2"]


@pytest.mark.parametrize("binary", [True, False])
def test_char_encoder_follows_dense_descent(world, binary):
    data, train, cells = world
    if binary:
        data = data.with_pairs(data.pairs.withColumn("y", (F.col("y") > 0.5).cast("double")))
        train = np.where(np.isfinite(train), (train > 0.5).astype(float), np.nan)
    known = np.isfinite(train)
    shift, scale = (0.0, 1.0) if binary else (train[known].mean(), train[known].std() + 1e-8)
    target = (train - shift) / scale
    freqs, tables = [], []
    for side, texts in (("a", LEFT), ("b", RIGHT)):
        vocab = {c: i + 1 for i, c in enumerate(sorted(set("".join(texts.values()))))}
        f = np.zeros((len(texts), len(vocab) + 1))
        for i, t in enumerate(texts.values()):
            for c in t:
                f[i, vocab[c]] += 1 / len(t)
        freqs.append(f)
        tables.append(0.05 * np.array(gaussian_matrix(1, f"chars-{side}", len(vocab) + 1, 8)))
    ba, bb, lr, l2, losses = np.zeros((6, 1)), np.zeros((1, 4)), 0.5, 1e-3, []
    for _ in range(3):
        va, vb = freqs[0] @ tables[0], freqs[1] @ tables[1]
        z = va @ vb.T + ba + bb
        p = 1 / (1 + np.exp(-z)) if binary else z
        diff = np.where(known, p - np.nan_to_num(target), 0)
        if binary:
            t = target[known]
            losses.append(-np.mean(t * np.log(p[known]) + (1 - t) * np.log(1 - p[known])))
        else:
            losses.append(np.mean(diff[known] ** 2))
        g = (1 if binary else 2) * diff / known.sum()
        ga, gb = freqs[0].T @ (g @ vb) + l2 * tables[0], freqs[1].T @ (g.T @ va) + l2 * tables[1]
        ba, bb = ba - lr * (g.sum(1, keepdims=True) + l2 * ba), bb - lr * (g.sum(0, keepdims=True) + l2 * bb)
        tables = [tables[0] - lr * ga, tables[1] - lr * gb]
    z = (freqs[0] @ tables[0]) @ (freqs[1] @ tables[1]).T + ba + bb
    expected = 1 / (1 + np.exp(-z)) if binary else z * scale + shift
    config = {"embedding_dim": 8, "epochs": 3, "lr": lr, "l2": l2, "seed": 1}
    found = char_encoder.predict(data, cells, config)
    np.testing.assert_allclose(found.loss_history, losses, atol=1e-9)
    np.testing.assert_allclose(grid_of(found.scores), expected, atol=1e-9)


@pytest.mark.parametrize("model", [{"name": "simple_baseline"}, {"name": "mixhop_propagation"}, {"name": "dual_frozen_backbone"},
                                   {"name": "matrix_factorization", "latent_dim": 2, "epochs": 2}])
def test_salting_hot_entities_changes_nothing(world, model):
    data, _, cells = world
    salted = data.with_pairs(data.pairs)
    salted.__dict__["hot"] = find_hot_keys(data.pairs, ["a", "b"], min_rows=1, share=9)
    assert salted.hot["a"].pieces and salted.hot["b"].pieces and not data.hot["a"].pieces
    predict = create_predictor(model)
    np.testing.assert_allclose(grid_of(predict(salted, cells).scores), grid_of(predict(data, cells).scores), atol=1e-12)


def test_models_without_training_pairs(world):
    data, _, cells = world
    nothing = data.with_pairs(data.pairs.withColumn("fold", F.lit("test")))
    assert grid_of(mixhop.predict(nothing, cells).scores).max() == 0.0
    assert np.isfinite(grid_of(simple.predict(nothing, cells).scores)).all()
    assert np.isfinite(grid_of(dual_view.predict(nothing, cells).scores)).all()
    assert grid_of(char_encoder.predict(nothing, cells).scores).max() == 0.0


def test_factory():
    with pytest.raises(ValueError):
        create_predictor("nope")
    with pytest.raises(ValueError):
        create_predictor({"name": "mixhop_propagation", "objective": "ranking"})
    assert create_predictor(None).func is simple.predict and create_predictor(" Mixhop_Propagation").func is mixhop.predict


def test_objectives(world):
    data, _, cells = world
    big = data.with_pairs(data.pairs.withColumn("y", F.col("y") * 9))
    assert grid_of(mixhop.predict(big, cells).scores).max() > 1
    assert grid_of(mixhop.predict(big, cells, {"objective": "binary"}).scores).max() <= 1


@pytest.mark.parametrize("rows", [200, 4])
def test_masked_reconstruction(spark, rows):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(rows, 8))
    x[:, 3] = x[:, 0] - 2 * x[:, 5] + 1 + rng.normal(size=rows)
    frame = spark.createDataFrame([(r.tolist(),) for r in x], "vec array<double>")
    found = robustness.masked_reconstruction(frame, 0.3, 5).first()
    positions = spark.range(8).select(F.col("id").cast("int").alias("position"))
    masked = sorted(r.position for r in robustness.column_mask(positions, 0.3, 5).where("is_masked").collect())
    assert len(masked) == 2 == found.n_masked and found.n_vectors == rows
    inputs = np.c_[np.delete(x, masked, axis=1), np.ones(rows)]
    beta = np.linalg.lstsq(inputs, x[:, masked], rcond=None)[0]
    assert found.loss == pytest.approx(np.mean((inputs @ beta - x[:, masked]) ** 2), abs=1e-9)


def test_diagnostics(spark, world):
    data, _, _ = world
    scored = data.pairs.withColumn("y_hat", F.lit(0.25))
    assert robustness.risk_variance(scored, 1).first().l_irm == 0.0
    assert robustness.risk_variance(scored.where("false"), 3).first().l_irm == 0.0
    one = spark.createDataFrame([("q1", "x")], "key string, content string")
    assert robustness.counterfactual_loss(scored, one, lambda c: c.withColumn('y_hat', F.lit(0.5))).first().asDict() == {"l_cf": 0.0, "n_cf_sampled": 0}
    assert robustness.counterfactual_loss(scored, data.right, lambda c: c.withColumn('y_hat', F.lit(0.5)), pos_threshold=5.0).first().n_cf_sampled == 0
    swaps = robustness.counterfactual_swaps(scored, data.right, lambda c: c.withColumn('y_hat', F.lit(0.5)), 0.1, 1000, 1)
    assert swaps.count() > 0 and swaps.where("b = b_swap").count() == 0
    assert robustness.perturb(data.pairs, 1.0).agg(F.max("y")).first()[0] == 0.0
    assert robustness.perturb(data.pairs, 0.0).exceptAll(data.pairs).count() == 0
    assert robustness.reliability(scored, scored).first()[0] == 1.0
    assert robustness.cross_view(scored, scored, scored, scored).first().causal_score == 1.0
    with pytest.raises(Exception, match="same cells"):
        robustness.cross_view(scored, scored, scored, scored.limit(3)).collect()
    losses = spark.createDataFrame([(0.5, 0.25, 8.0, 0.5)], "l_xview double, l_mas double, l_irm double, l_cf double")
    assert robustness.unified(losses).first().l_total == 2.25
    assert robustness.unified(losses, {"lambda_irm": 0.0}).first().l_total == 1.25
    assert robustness.unified(losses, dict.fromkeys(["lambda_xview", "lambda_mas", "lambda_irm", "lambda_cf"], 0.0)).first().unified_causal_score == 1.0
