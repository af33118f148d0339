"""Gradient steps over dealt pairs against dense numpy, and what their plans exchange."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadic.operators.pairs import PairData
from dyadic.plans import catalog, model_queries
from dyadic.predictors import char_encoder, factorization, gradients
from dyadic.predictors.gradients import DealtPairs, squared_slope


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(2)
    cells = sorted({(0, j) for j in range(25)} | {(i, 3) for i in range(60)} | {(int(i), int(j)) for i, j in rng.integers(0, [60, 25], (300, 2))})
    rows = [(f"a{i}", f"b{j}", float(rng.integers(0, 2))) for i, j in cells]  # a0 and b3 meet everyone
    entities = lambda p, n: spark.createDataFrame([(f"{p}{i}", "x" * (i % 5) + "yz"[i % 2]) for i in range(n)], "key string, content string")
    return PairData(spark.createDataFrame(rows, "a string, b string, y double"), entities("a", 61), entities("b", 26)), rows


def vectors(dealt, seed):
    found = dealt.nodes.withColumn("vec", F.array(*[F.sin(F.xxhash64("side", "key", F.lit(seed + d)) % 1000 / 7.0) for d in range(3)]))
    return found, {(r.side, r.key): np.array(r.vec) for r in found.collect()}


@pytest.mark.parametrize(("block", "cell_pairs"), [(1000, 10_000), (7, 10_000), (7, 5), (1000, 20)])
@pytest.mark.parametrize("slope", [squared_slope, char_encoder.cross_entropy_slope])
def test_gradients_equal_dense_ones(spark, world, block, cell_pairs, slope):
    data, rows = world
    dealt = DealtPairs.deal(data, data.pairs, block, cell_pairs)
    frame, vec = vectors(dealt, 1)
    found = dealt.gradients(frame, 3, slope).join(dealt.nodes, ["side", "block", "no"]).collect()
    want, loss = {}, 0.0
    for a, b, y in rows:
        g, one = slope(np.array([vec["a", a] @ vec["b", b]]), np.array([y]))
        want["a", a] = want.get(("a", a), 0) + g[0] * vec["b", b]
        want["b", b] = want.get(("b", b), 0) + g[0] * vec["a", a]
        loss += one[0]
    assert {(r.side, r.key) for r in found} == set(want)  # entities without pairs have no gradient
    assert all(np.allclose(r.grad, want[r.side, r.key], atol=1e-12) for r in found)
    assert sum(r.loss for r in found) == pytest.approx(loss, abs=1e-9)
    if block == 1000 and cell_pairs == 20:
        assert dealt.cells.count() > 5  # one block on each side, and still several tasks
    dealt.forget()


def test_a_step_does_not_exchange_the_pairs(spark, world):
    data, _ = world
    dealt = DealtPairs.deal(data, data.pairs, 7, 50)
    step = dealt.gradients(vectors(dealt, 1)[0], 3, squared_slope)
    plan = step._jdf.queryExecution().executedPlan().toString()
    cogroup = plan[plan.index("FlatMapCoGroupsInArrow"):]
    scan = next(line for line in cogroup.splitlines() if dealt.name in line)
    above = cogroup[: cogroup.index(scan)].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
    chain, at = [], depth(scan)
    for line in reversed(above):
        if depth(line) < at:
            chain.append(line)
            at = depth(line)
    assert "FlatMapCoGroupsInArrow" in chain[-1] and not any("Exchange" in line for line in chain)
    assert "Bucketed: true" in scan
    dealt.forget()


def test_no_training_pairs(spark, world):
    data, _ = world
    empty = data.with_pairs(data.pairs.where("false"))
    factors, _, n = factorization.fit(empty, {"latent_dim": 2, "epochs": 2})
    assert n == 0 and factors.count() == 87
    assert factorization.predict(empty, data.pairs, {"latent_dim": 2, "epochs": 1}).scores.count() == data.size


@pytest.mark.parametrize(("module", "config", "binary"), [
    (factorization, {"latent_dim": 3, "epochs": 4, "lr": 2.0}, True),
    (char_encoder, {"embedding_dim": 8, "epochs": 4, "lr": 3.0, "l2": 0.01}, True),
    (char_encoder, {"embedding_dim": 8, "epochs": 4, "lr": 0.5}, False),
])
def test_epochs_in_one_task_equal_epochs_over_cells(spark, world, monkeypatch, module, config, binary):
    data, _ = world
    if not binary:
        data = data.with_pairs(data.pairs.withColumn("y", F.col("y") + F.length("a")))
    found = []
    for pairs_of_a_task in (gradients.ONE_TASK, 0):
        monkeypatch.setattr(gradients, "ONE_TASK", pairs_of_a_task)
        monkeypatch.setattr(gradients, "BLOCK", 20)
        monkeypatch.setattr(gradients, "FEW_PAIRS", 50)
        said = module.predict(data, None, config)
        found.append((said.loss_history, {(r.a, r.b): r.y_hat for r in said.scores.collect()}))
    (one, scores), (many, others) = found
    assert len(one) == 4 and one == pytest.approx(many, abs=1e-12) and one[0] - one[-1] > 1e-4
    assert scores.keys() == others.keys() and all(scores[k] == pytest.approx(others[k], abs=1e-12) for k in scores)


@pytest.mark.parametrize(("name", "wanted"), [
    ("predict_mf", {"epochs": 100, "latent_dim": 32}), ("predict_cross_attention", {"epochs": 100, "latent_dim": 32}),
    ("predict_char_encoder", {"epochs": 30, "embedding_dim": 64}),
])
def test_trained_queries_take_every_epoch_of_their_model(spark, world, monkeypatch, name, wanted):
    """The defaults of the models, in the query and in its SQL."""
    data, rows = world
    steps, widths = [], []

    def counted(tables, pairs, slope):
        steps.append(len(pairs[2]))
        widths.append(tables["a"].shape[1])
        return summed(tables, pairs, slope)

    def here(self, entities, run):
        table = entities.drop("key").toArrow().combine_chunks()
        return spark.createDataFrame(run(table, gradients._pairs(spark.table(self.name).toArrow())).to_pandas())

    summed = gradients.summed_slopes
    for module in (gradients, char_encoder):
        monkeypatch.setattr(module, "summed_slopes", counted)
    monkeypatch.setattr(gradients.DealtPairs, "in_the_cell", here)
    monkeypatch.setattr(model_queries, "item_data", lambda *_: data)
    assert catalog.QUERIES[name](spark, "").count() == len(rows)
    assert steps == [len(rows)] * wanted["epochs"]
    assert set(widths) == {wanted.get("latent_dim") or wanted["embedding_dim"] + 2}
    last = wanted["epochs"]
    assert ("ta%d " if "embedding_dim" in wanted else "a%d ") % last in catalog.ORACLES[name]
