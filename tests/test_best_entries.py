"""Best entries of a product tile by tile, packed rows, block sizes, and what plans of pair products exchange."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadic.operators import best
from dyadic.operators.blocks import block_counts as stripe_counts
from dyadic.operators.packing import packed
from dyadic.operators.pair_dots import block_counts, pair_dots


def brute(x, y, k, rank, x_bias, y_bias, floor, struck, most):
    scores = np.round(np.minimum(x @ y.T + x_bias[:, None] + y_bias, most), 9)
    scores[struck] = -np.inf
    return {(i, int(j), scores[i, j]) for i in range(len(x)) for j in np.lexsort((rank, -scores[i]))[:k]
            if scores[i, j] > -np.inf and scores[i, j] >= floor[i] - best.SLACK}


@pytest.mark.parametrize("seed", range(24))
def test_best_entries_equal_the_whole_product(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(best, "ROWS", (5, 512)[seed % 2])
    monkeypatch.setattr(best, "COPIES", (2, 32)[seed // 2 % 2])
    n, m, width, k = rng.integers(1, 40), rng.integers(1, 60), rng.integers(1, 6), rng.integers(1, 9)
    if seed % 3:  # many ties and equal vectors
        x, y = rng.integers(-2, 3, (n, width)) / 4, rng.integers(-2, 3, (m, width)) / 4
    else:  # large and small numbers
        x, y = rng.normal(size=(n, width)) * 10.0 ** rng.integers(-5, 5), rng.normal(size=(m, width))
    x_bias, y_bias, rank = rng.integers(0, 3, n) / 2, rng.integers(0, 3, m) / 4, rng.permutation(m)
    struck, floor = np.nonzero(rng.random((n, m)) < 0.2), np.where(rng.random(n) < 0.5, -np.inf, rng.normal(size=n))
    most = 0.5 if seed % 5 == 0 else np.inf
    found = best.best_entries(x, y, k, rank, x_bias, y_bias, floor, struck, most=most, columns=(3, 16, 512)[seed % 3])
    want = brute(x, y, k, rank, x_bias, y_bias, floor, struck, most)
    key = lambda rows: sorted((int(i), int(j), float(s)) for i, j, s in rows)
    assert [r[:2] for r in key(zip(*found, strict=True))] == [r[:2] for r in key(want)]
    assert np.allclose([r[2] for r in key(zip(*found, strict=True))], [r[2] for r in key(want)], atol=2e-9, rtol=1e-12)


def test_numbers_beyond_single_precision():
    x, y = np.array([[1e30, 1.0]]), np.array([[1e30, 0.0], [1e30, 3e45], [-1e30, 0.0]])
    assert [a.tolist() for a in best.best_entries(x, y, 1, np.arange(3))[:2]] == [[0], [1]]


def test_few_large_blocks():
    """Copies of a vector follow the blocks of the other side: they are bounded by memory, not by a small fixed size."""
    assert block_counts({"a": 7_200_000, "b": 360_000}, 16, 4096, 12) == {"a": 28, "b": 2}
    assert block_counts({"a": 20_000, "b": 1_000}, 16, 4096, 8) == {"a": 5, "b": 1}
    assert block_counts({"a": 10, "b": 50_000}, 16, 4096, 8) == {"a": 1, "b": 8}


def test_stripes_follow_the_width(spark):
    vectors = spark.range(9000).select(F.col("id").cast("string").alias("id"), F.array_repeat(F.lit(1.0), 4).alias("vec"))
    left, right = stripe_counts(vectors, vectors, 64)
    assert left <= 9 and right == 5  # blocks of one slice were 141, stripes of eight 18


def test_pairs_of_a_product_are_exchanged_once(spark):
    side = lambda n: spark.range(n).select(F.col("id").cast("string").alias("key"), F.array(F.col("id") * 1.0, F.lit(2.0)).alias("vec"))
    pairs = spark.range(60).select((F.col("id") % 10).cast("string").alias("a"), (F.col("id") % 7).cast("string").alias("b"))
    found = pair_dots(pairs, side(10).withColumn("tag", F.concat(F.lit("t"), "key")), side(6), cell_pairs=9)
    assert all(r.dot == (int(r.a) * int(r.b) + 4.0 if r.b != "6" else None) and r.tag == "t" + r.a for r in found.collect()) and found.count() == 60
    plan = pair_dots(pairs, side(10), side(6))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_packed_rows_are_exchanged_once(spark):
    frame = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    lists = packed(frame, ["k"], ["id"], ["id"])
    assert lists.count() <= 3 * 64 and lists.select(F.explode("_rows")).count() == 500
    plan = lists.groupBy("k").applyInArrow(lambda t: t.select(["k"]), "k long")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
