"""Stored vectors: dot products of pairs by blocks, numpy archives, settings that name them."""

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from dyadic.functions.hashing import gaussian_matrix
from dyadic.operators.pair_dots import pair_dots
from dyadic.predictors.dual_view import project
from dyadic.runs import artifacts
from dyadic.runs.config import validate, vector_settings
from dyadic.runs.runner import run_once
from dyadic.sources.tables import read_embeddings, stored_vectors

SIDE = "key string, vec array<double>"


@pytest.mark.parametrize("block", [3, 1000])
def test_dots_of_pairs(spark, block):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(20, 5)), rng.normal(size=(9, 5))
    pairs = [(f"a{i}", f"b{j}", i * j) for i in range(22) for j in range(10) if i == 0 or j == 0 or (i + j) % 3]  # a20, a21 and b9 are unknown
    sides = [spark.createDataFrame([(f"{p}{i}", v.tolist()) for i, v in enumerate(t)] + [(f"{p}none", None)], SIDE) for p, t in (("a", x), ("b", y))]
    found = pair_dots(spark.createDataFrame(pairs, "a string, b string, y long"), *sides, block=block).collect()
    assert sorted((r.a, r.b, r.y) for r in found) == sorted(pairs)
    for r in found:
        i, j = int(r.a[1:]), int(r.b[1:])
        assert r.dot is None if i >= 20 or j >= 9 else r.dot == pytest.approx(x[i] @ y[j], abs=1e-12)
    assert pair_dots(spark.createDataFrame([], "a string, b string"), *sides).count() == 0
    plan = pair_dots(spark.createDataFrame(pairs, "a string, b string, y long"), *sides)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_projection_is_the_seeded_matrix(spark):
    x = np.random.default_rng(2).normal(size=(7, 12))
    frame = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], SIDE)
    found = {int(r.key): np.array(r.vec) for r in project(frame, 5, "left", 12, 4).collect()}
    want = x @ np.array(gaussian_matrix(5, "left", 4, 12)).T / np.sqrt(12)
    assert all(np.allclose(found[i], want[i], atol=1e-12) for i in range(7))
    assert project(frame.limit(0), 5, "left", 12, 4).count() == 0


def test_numpy_archive(spark, tmp_path):
    vectors = np.arange(5000, dtype=np.float32).reshape(2500, 2)
    np.savez(tmp_path / "v.npz", keys=np.array([f"k{i}" for i in range(2500)]), embeddings=vectors)
    found = read_embeddings(spark, str(tmp_path / "v.npz"))
    assert found.count() == 2500 and found.where("key = 'k1024'").first().embedding == [2048.0, 2049.0]
    np.savez(tmp_path / "bare.npz", embeddings=vectors)
    with pytest.raises(Exception, match="keys"):
        read_embeddings(spark, str(tmp_path / "bare.npz")).collect()
    assert stored_vectors(spark, str(tmp_path / "none.npz")) is None and stored_vectors(spark, None) is None


def test_settings_of_vectors():
    good = {"name": "x", "protocol": "P", "output": {"base_dir": "o"}}
    assert validate({**good, "model": {"chemberta_npz_path": "v.npz", "ankh_npz_path": None}}) == []
    assert validate({**good, "model": {"chemberta_npz_path": 3, "layers": 2}}) == [
        "model.chemberta_npz_path must be a path or null", "model.layers is not a setting of this section"]
    assert validate({**good, "causal": {"mas_config": {"drug_npz_path": None, "depth": 1}}}) == ["causal.mas_config.depth is not a setting of this section"]
    assert vector_settings({"chemberta_npz_path": "v", "ankh_npz_path": None, "seed": 1}) == {"left_vectors": "v", "seed": 1}
    assert vector_settings({"chemberta_npz_path": "v", "left_vectors": "w"}) == {"left_vectors": "w"}


def test_run_with_stored_vectors(spark, tmp_path):
    """The archive is read under its setting's own name: other vectors, other scores."""
    rows = "\n".join(f"d{i},{'C' * (i + 1)},t{j},{'M' * (j + 1)},{(i + j) % 2}" for i in range(6) for j in range(4))
    (tmp_path / "b.csv").write_text("Drug_ID,Drug,Target_ID,Target,Label\n" + rows + "\n")
    rng, scores = np.random.default_rng(0), []
    for side, n, p in (("l", 6, "d"), ("r", 4, "t")):
        np.savez(tmp_path / f"{side}.npz", keys=np.array([f"{p}{i}" for i in range(n)]), embeddings=rng.normal(size=(n, 8)))
    for name, vectors in (("plain", {}), ("stored", {"chemberta_npz_path": str(tmp_path / "l.npz"), "ankh_npz_path": str(tmp_path / "r.npz")})):
        config = {"name": name, "protocol": "P", "output": {"base_dir": str(tmp_path / "out")}, "dataset": {"name": "KIBA", "path": str(tmp_path / "b.csv")},
                  "model": {"name": "dual_frozen_backbone", **vectors}}
        (tmp_path / f"{name}.yaml").write_text(yaml.safe_dump(config))
        assert run_once(spark, str(tmp_path / f"{name}.yaml"), binary=True) == 0
        folder = artifacts.latest_run(spark, str(tmp_path / "out"), name)
        scores.append({(r.a, r.b): r.y_hat for r in spark.read.parquet(f"{folder}/{artifacts.PREDICTIONS}").collect()})
    assert len(scores[0]) == len(scores[1]) == 24 and scores[0] != scores[1]
    assert spark.read.parquet(f"{folder}/{artifacts.PREDICTIONS}").agg(F.count_if(F.col("y_hat").isNull())).first()[0] == 0
