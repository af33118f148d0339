import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadic.operators import binary_metrics, regression_metrics
from dyadic.operators.concordance import concordance, weighted_concordant
from dyadic.operators.ordering import Ranges, measure_ranges, prefix_sums, sorted_position, string_ranges


def frame(spark, y, p):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "k int, y double, y_hat double")


def brute_ci(y, p):
    y, p = np.asarray(y, float), np.asarray(p, float)
    ordered = y[:, None] > y[None, :]
    better, same = p[:, None] > p[None, :], p[:, None] == p[None, :]
    return (np.sum(ordered & better) + 0.5 * np.sum(ordered & same)) / ordered.sum()


@pytest.mark.parametrize("y, p, expected", [
    ([1, 2, 3], [1, 2, 3], dict(mse=0, rmse=0, pearson=1, spearman=1, ci=1)),
    ([1, 2, 3], [3, 2, 1], dict(pearson=-1, spearman=-1, ci=0)),
    ([1, 2, 3], [5, 5, 5], dict(pearson=0, spearman=0, ci=0.5)),
    ([1, 1, 2, 3], [1, 1, 2, 3], dict(spearman=1)),
    ([2, 2, 2], [1, 2, 3], dict(ci=0.5)),
    ([1], [4], dict(pearson=0, spearman=0, ci=0, mse=9)),
])
def test_regression_goldens(spark, y, p, expected):
    found = regression_metrics.evaluate_regression(frame(spark, y, p)).first().asDict()
    for name, value in expected.items():
        assert found[name] == pytest.approx(value, abs=1e-12), name


def test_regression_ignores_unusable_rows(spark):
    rows = [(1.0, 2.0), (float("nan"), 1.0), (None, 1.0), (2.0, float("inf")), (3.0, 3.0)]
    found = regression_metrics.evaluate_regression(spark.createDataFrame(rows, "y double, y_hat double")).first()
    assert found.n_evaluated == 2 and found.mse == pytest.approx(0.5)
    empty = regression_metrics.evaluate_regression(spark.createDataFrame([], "y double, y_hat double")).first()
    assert empty.n_evaluated == 0 and empty.mse is None and empty.ci is None and empty.spearman is None


def skewed(n=3000, seed=5):
    rng = np.random.default_rng(seed)
    y, p = rng.integers(0, 400, n).astype(float), np.round(rng.normal(size=n), 2)
    y[: n // 3], p[n // 4: n // 2] = 7.0, 0.25  # one truth and one score hold a large share
    return y, p


def test_local_count_matches_brute_force():
    y, p = skewed(400)
    w = np.random.default_rng(1).integers(1, 4, 400)
    full_y, full_p = np.repeat(y, w), np.repeat(p, w)
    ordered = full_y[:, None] > full_y[None, :]
    expected = np.sum(ordered & (full_p[:, None] > full_p)) + 0.5 * np.sum(ordered & (full_p[:, None] == full_p))
    assert weighted_concordant(y, p, w) == expected


@pytest.mark.parametrize("local_rows", [6, 300, 10_000])
def test_concordance_is_exact_however_often_it_is_cut(spark, local_rows):
    y, p = skewed()
    assert concordance(frame(spark, y, p), local_rows).first().ci == pytest.approx(brute_ci(y, p), abs=1e-12)


def test_measured_ranges_single_out_frequent_values(spark):
    _, ranges = measure_ranges(frame(spark, *skewed()), ["y", "y_hat"], 50)
    assert 7.0 in ranges["y"].frequent and 0.25 in ranges["y_hat"].frequent


@pytest.mark.parametrize("rows_per_range", [60, 10_000])
def test_ranks_and_areas_over_many_ranges(spark, rows_per_range):
    y, p = skewed()
    data = frame(spark, y, p)
    measured = measure_ranges(data, ["y", "y_hat"], rows_per_range)
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    expected = np.corrcoef(rank(y), rank(p))[0, 1]
    assert regression_metrics.spearman(data, measured).first().spearman == pytest.approx(expected, abs=1e-9)
    labels = (y > 200).astype(float)
    data = frame(spark, labels, p)
    measured = measure_ranges(data, ["y_hat"], rows_per_range)
    assert binary_metrics.auroc(data, measured).first().auroc == pytest.approx(brute_ci(labels, p), abs=1e-12)
    import hashlib

    order = sorted(range(len(p)), key=lambda i: (-p[i], hashlib.md5(f"0|{i}".encode()).hexdigest()))
    hits = labels[order]
    precision = np.cumsum(hits) / np.arange(1, len(hits) + 1)
    expected = precision[hits == 1].sum() / hits.sum()
    assert binary_metrics.auprc(data, ["k"], measured).first().auprc == pytest.approx(expected, abs=1e-12)


def test_binary_with_an_absent_class(spark):
    found = binary_metrics.evaluate_binary(frame(spark, [1, 1, 1], [0.9, 0.2, 0.6]), ["k"]).first()
    assert (found.auroc, found.auprc, found.specificity) == (0.5, 1.0, 0.0)
    assert found.sensitivity == pytest.approx(2 / 3) and found.n_negative == 0
    found = binary_metrics.evaluate_binary(frame(spark, [0, 0], [0.9, 0.2]), ["k"]).first()
    assert (found.auroc, found.auprc, found.f1, found.precision) == (0.5, 0.0, 0.0, 0.0)
    empty = binary_metrics.evaluate_binary(frame(spark, [], []), ["k"]).first()
    assert empty.auroc is None and empty.f1 is None and empty.n_evaluated == 0


def test_prefix_sums_and_buckets(spark):
    values = [(float(v), v % 5 + 1) for v in range(1000)]
    data = spark.createDataFrame(values, "v double, w int")
    _, ranges = measure_ranges(data, ["v"], 100)
    assert len(ranges["v"].bounds) > 5
    for descending in (False, True):
        found = {r.v: r.t for r in prefix_sums(data, "v", {"t": "w"}, ranges["v"], descending).collect()}
        total = 0
        for v, w in sorted(values, reverse=descending):
            total += w
            assert found[v] == total
    single = Ranges((1.0, 5.0), frozenset({5.0}))
    got = data.select("v", single.bucket("v").alias("b")).where("v < 8").collect()
    assert [r.b for r in sorted(got)] == [0, 0, 2, 2, 2, 3, 4, 4]


def test_sorted_position_over_string_ranges(spark, monkeypatch):
    from dyadic.operators import ordering

    keys = sorted({f"k{i * 7919 % 100003}'x" for i in range(3000)} | {"é", "10", "2"})
    data = spark.createDataFrame([(k,) for k in keys], "key string")
    monkeypatch.setattr(ordering, "STRING_SAMPLE", 512)
    ranges = string_ranges(data, "key", 512)
    assert ranges.bounds
    monkeypatch.setattr(ordering, "string_ranges", lambda f, k: ranges)
    found = {r.key: r.idx for r in sorted_position(data, "key").collect()}
    assert found == {k: i for i, k in enumerate(sorted(keys, key=lambda s: s.encode()))}
    assert data.select(F.max("key")).first()[0] == "é"


@pytest.mark.parametrize("descending", [False, True])
def test_oversized_ranges_are_split_level_by_level(spark, monkeypatch, descending):
    from dyadic.operators import ordering

    monkeypatch.setattr(ordering, "BOUNDS", 4)
    values = [(float(v * v % 100_003), v % 7 + 1) for v in range(4000)]
    data = spark.createDataFrame([(v, sum(w for x, w in values if x == v)) for v in {v for v, _ in values}], "v double, w int")
    _, ranges = measure_ranges(data, ["v"], 10, max_ranges=4)
    assert ranges["v"].capped and len(ranges["v"].bounds) == 3
    keyed, levels = ordering.refine(data.withColumn("_g0", ranges["v"].bucket("v")), "v", ["_g0"], 40)
    assert len(levels) >= 3 and keyed.groupBy(*levels).count().agg(F.max("count")).first()[0] <= 40
    assert keyed.groupBy(*levels[:-1]).agg(F.countDistinct(levels[-1]).alias("n")).agg(F.max("n")).first()[0] <= 16
    found = {r.v: r.t for r in prefix_sums(data, "v", {"t": "w"}, ranges["v"], descending, rows_per_range=10).collect()}
    total = 0
    for v, w in sorted(((r.v, r.w) for r in data.collect()), reverse=descending):
        total += w
        assert found[v] == total


def test_many_equal_scores_are_dealt_in_levels(spark):
    import hashlib

    _, p = skewed(2000)
    p[:1500] = 0.25
    labels = (np.random.default_rng(3).random(2000) < 0.4).astype(float)
    order = sorted(range(2000), key=lambda i: (-p[i], hashlib.md5(f"0|{i}".encode()).hexdigest()))
    hits = labels[order]
    expected = (np.cumsum(hits) / np.arange(1, 2001))[hits == 1].sum() / hits.sum()
    for tie_rows in (2, 100, 10_000):  # two levels, one level, none
        found = binary_metrics.auprc(frame(spark, labels, p), ["k"], tie_rows=tie_rows).first().auprc
        assert found == pytest.approx(expected, abs=1e-12)


def test_all_regression_metrics_of_repeated_pairs(spark):
    y, p = skewed()
    found = regression_metrics.evaluate_regression(frame(spark, np.tile(y, 3), np.tile(p, 3))).first()
    y, p = np.tile(y, 3), np.tile(p, 3)
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    assert found.n_evaluated == 9000 and found.mse == pytest.approx(np.mean((y - p) ** 2)) and found.rmse == pytest.approx(found.mse ** 0.5)
    assert found.pearson == pytest.approx(np.corrcoef(y, p)[0, 1], abs=1e-9)
    assert found.spearman == pytest.approx(np.corrcoef(rank(y), rank(p))[0, 1], abs=1e-9)
    assert found.ci == pytest.approx(brute_ci(y, p), abs=1e-12)


def test_pairs_are_grouped_once_for_all_regression_metrics(spark):
    plan = regression_metrics.evaluate_regression(frame(spark, *skewed()))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(y_hat#" in plan
    assert not re.search(r"hashpartitioning\(y#\d+, y_hat#", plan)


def test_ordered_values_are_merged_once(spark):
    """Totals and the sums inside a bucket read one stored table instead of merging the values twice."""
    data = spark.range(3000).select((F.col("id") % 1000).cast("double").alias("v"), F.lit(1).alias("w"))
    _, ranges = measure_ranges(data, ["v"], 100)
    found = prefix_sums(data.groupBy("v").agg(F.sum("w").alias("w")), "v", {"t": "w"}, ranges["v"])
    assert "hashpartitioning(v#" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.v: r.t for r in found.collect()} == {float(v): 3 * (v + 1) for v in range(1000)}
