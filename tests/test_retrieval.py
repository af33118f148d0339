"""Best unmeasured pairs against a full product, with ties, known pairs, small stripes and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadic.operators import retrieval
from dyadic.operators.retrieval import top_unknown

SIDE = "key string, vec array<double>, bias double"


def side(spark, prefix, vectors, biases):
    rows = [(f"{prefix}{i}", [float(x) for x in v], float(b)) for i, (v, b) in enumerate(zip(vectors, biases, strict=True))]
    return spark.createDataFrame(rows, SIDE)


def brute(left, right, known, k):
    found = set()
    for a in left.collect():
        cells = []
        for b in right.collect():
            if (a.key, b.key) not in known:
                cells.append((-round(float(np.dot(a.vec, b.vec)) + a.bias + b.bias, 9), b.key))
        found |= {(a.key, b, -s, r) for r, (s, b) in enumerate(sorted(cells)[:k], 1)}
    return found


def rows(frame):
    return {(r.a, r.b, round(r.score, 9), r["rank"]) for r in frame.collect()}


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(4)
    scale = rng.exponential(1.0, 90)[:, None]
    x, y = rng.integers(-4, 5, (40, 3)) / 4, rng.integers(-4, 5, (90, 3)) / 4 * np.ceil(scale)
    left, right = side(spark, "a", x, rng.integers(0, 3, 40)), side(spark, "b", y, rng.integers(0, 3, 90))
    pairs = {(f"a{i}", f"b{j}") for i, j in zip(rng.integers(0, 40, 600), rng.integers(0, 90, 600), strict=True)}
    pairs |= {("a0", f"b{j}") for j in range(90)} | {("a1", f"b{j}") for j in range(88)} | {(f"a{i}", "b5") for i in range(40)} | {("gone", "b1")}
    return left, right, pairs


@pytest.mark.parametrize("stripe", [7, 1000])
@pytest.mark.parametrize("k", [1, 4, 200])
def test_equals_the_full_product(spark, world, monkeypatch, stripe, k):
    monkeypatch.setattr(retrieval, "SLICE", 3)
    left, right, pairs = world
    known = spark.createDataFrame(sorted(pairs), "a string, b string")
    found = rows(top_unknown(left, right, known, k, block=6, stripe=stripe))
    assert found == brute(left, right, pairs, k)
    assert not any(a == "a0" for a, _, _, _ in found) and 0 < sum(a == "a1" for a, _, _, _ in found) <= 2


def test_equal_scores_and_one_reach(spark):
    """All right entities are alike: one range of reach, split by hash, and ties by name."""
    left, right = side(spark, "a", [[1, 0]] * 3, [0] * 3), side(spark, "b", [[0.5, 0.5]] * 50, [0] * 50)
    assert rows(top_unknown(left, right, None, 3, stripe=4)) == {(f"a{i}", b, 0.5, r) for i in range(3) for r, b in ((1, "b0"), (2, "b1"), (3, "b10"))}


def test_empty_sides(spark, world):
    left, right, _ = world
    assert top_unknown(left, right.limit(0), None, 3).count() == 0
    assert top_unknown(left.limit(0), right, None, 3).count() == 0
    assert top_unknown(left, right, spark.createDataFrame([], "a string, b string"), 1).count() == 40


def test_bounds_leave_most_stripes_out(spark):
    """Long vectors come first; with a floor from them nearly all short ones are never met."""
    rng = np.random.default_rng(1)
    long, short = rng.normal(size=(200, 4)) * 10, rng.normal(size=(4000, 4)) * 0.1
    left = side(spark, "a", rng.normal(size=(60, 4)), [0] * 60)
    right = side(spark, "b", np.vstack([long, short]), [0] * 4200)
    _, stripes = retrieval.striped(right, 1.0, 200)
    assert len(stripes.buckets) >= 15 and stripes.buckets[0][4] > 100 * stripes.buckets[-1][4]
    best = top_unknown(left, right, None, 5, stripe=200)
    floors = best.groupBy(F.col("a").alias("key")).agg(F.min("score").alias("floor"))
    left = left.withColumn("norm", F.sqrt(F.expr("aggregate(vec, 0D, (s, x) -> s + x * x)")))
    met = left.join(floors, "key").select(F.size(stripes.reachable(F.col("bias"), F.col("norm"), F.col("floor"))).alias("n"))
    assert met.agg(F.sum("n")).first()[0] < 0.15 * 60 * len(stripes.buckets)
    assert rows(best.where("a = 'a7'")) == {r for r in brute(left.where("key = 'a7'"), right, set(), 5)}
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_known_pairs_of_a_task_are_few_and_travel_in_lists(spark, world, monkeypatch):
    left, right, pairs = world
    frames = []
    monkeypatch.setattr(retrieval, "STRUCK", 60)
    monkeypatch.setattr(retrieval, "packed", lambda frame, *args, pack=retrieval.packed: frames.append(frame) or pack(frame, *args))
    found = rows(top_unknown(left, right, spark.createDataFrame(sorted(pairs), "a string, b string"), 4, stripe=40))
    assert found == brute(left, right, pairs, 4)
    sent = [f.where("others is not null") for f in frames if "others" in f.columns]
    each = [r for f in sent for r in f.select("block", "stripe", "key", F.size("others").alias("n")).collect()]
    assert sum(r.n for r in each) == sum(b in {x.key for x in right.collect()} for _, b in pairs)
    assert len({(r.stripe, r.key) for r in each}) == len(each)  # one list for each left entity and stripe
    assert len({r.block for r in each}) > 3  # all left entities would fit one block, but not their known pairs
