"""Cases that once gave wrong results without a message."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadic import session
from dyadic.functions.numeric import clip
from dyadic.operators import blocks
from dyadic.operators.robustness import counterfactual_swaps
from dyadic.predictors.dual_view import lookup_embeddings
from dyadic.sources import tables


def test_clip_keeps_null(spark):
    assert [r.c for r in spark.sql("select * from values (null), (2.0D), (-1.0D) t(v)").select(clip(F.col("v"), 0, 1).alias("c")).collect()] == [None, 1.0, 0.0]


def test_quoted_fields(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n"x ""y"", z",1\nplain,2\n')
    assert sorted((r.a, r.b) for r in tables.read_strings(spark, str(tmp_path / "q.csv")).collect()) == [("plain", "2"), ('x "y", z', "1")]


def test_folders_and_uris_are_found(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    for k in range(2):
        (folder / f"part-{k}.csv").write_text("h\n1\n")
    assert tables.resolve_layout(spark, str(folder), "DAVIS") == ("csv", str(folder))
    uri = (folder / "part-0.csv").as_uri()
    assert tables.resolve_layout(spark, uri, "DAVIS") == ("csv", uri)
    assert tables.resolve_layout(spark, str(tmp_path / "none"), "DAVIS") is None


def test_unknown_triplet_cells_stay_unknown(spark, tmp_path):
    for name, text in zip(tables.TRIPLET, ("l0\nl1\n", "r0\nr1\n", "1 nan\n2 3\n"), strict=True):
        (tmp_path / name).write_text(text)
    data = tables.read_triplet(spark, str(tmp_path), "DAVIS")
    assert data.pairs.count() == 3 and data.with_pairs(data.pairs).meta["all_cells_listed"]


def test_missing_vectors_have_the_width_of_the_table(spark):
    entities = spark.createDataFrame([("p", "abc"), ("q", "abd")], "key string, content string")
    stored = spark.createDataFrame([("p", [1.0, 2.0, 3.0, 4.0]), ("p", [0.0] * 4)], "key string, embedding array<double>")
    found = {r.key: r.vec for r in lookup_embeddings(entities, stored).collect()}
    counts = np.bincount([ord(c) % 4 for c in "abd"], minlength=4)
    assert found["p"] == [1.0, 2.0, 3.0, 4.0] and len(found["q"]) == 4
    assert np.allclose(np.array(found["q"]) / np.linalg.norm(found["q"]), counts / np.linalg.norm(counts))
    with pytest.raises(ValueError):
        lookup_embeddings(entities, stored.union(spark.createDataFrame([("r", [1.0])], stored.schema)))


def test_all_positives_are_swapped(spark):
    scored = spark.range(3000).select(F.col("id").cast("string").alias("a"), F.explode(F.array(F.lit("x"), F.lit("y"))).alias("b"), F.lit(1.0).alias("y"), F.lit(0.5).alias("y_hat"))
    right = spark.createDataFrame([("x", ""), ("y", "")], "key string, content string")
    assert counterfactual_swaps(scored, right, lambda c: c.withColumn('y_hat', F.lit(0.5))).count() == 6000
    assert counterfactual_swaps(scored, right, lambda c: c.withColumn('y_hat', F.lit(0.5)), n_cf_pairs=10).count() == 10


def named(setting, context=None):
    option = SimpleNamespace(isDefined=lambda: context is not None, get=lambda: context)
    java = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: option))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: setting), sparkContext=SimpleNamespace(_jsc=java))


def test_only_named_folders_are_written():
    assert session.checkpoint_folder(named("hdfs://x/y/")) == "hdfs://x/y"
    assert session.checkpoint_folder(named(None, "hdfs://z")) == "hdfs://z"
    with pytest.raises(ValueError):
        session.checkpoint_folder(named(None))


def test_products_over_stripes_equal_dense_ones(spark):
    """Several slices a stripe and several stripes; ties go to the smaller id."""
    rng = np.random.default_rng(3)
    left, right = rng.integers(0, 3, (20, 4)) / 6.0, rng.integers(0, 3, (61, 4)) / 6.0
    frame = lambda x, name: spark.createDataFrame([(f"{name}{i:02}", v.tolist(), 2) for i, v in enumerate(x)], "id string, vec array<double>, n int")
    a, b = frame(left, "a"), frame(right, "b")
    sims = np.round(left @ right.T, 9)
    best = {(r.id, r.other): r.sim for r in blocks.top_products(a, b, 3, block=4).collect()}
    for i, row in enumerate(sims):
        for j in np.lexsort((np.arange(len(row)), -row))[:3]:
            assert row[j] == 0 or best[(f"a{i:02}", f"b{j:02}")] == row[j]
    assert blocks.largest_product(a, b, block=4).first().largest == pytest.approx((left @ right.T).max())
    profile = {r.id: (r.total, r.best_other) for r in blocks.row_profile(a, b, block=4).collect()}
    for i, row in enumerate(left @ right.T):
        assert profile[f"a{i:02}"] == (pytest.approx(2 * row.sum()), pytest.approx(row.max()))
