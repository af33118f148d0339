import json
from concurrent.futures import ThreadPoolExecutor

import pytest
import yaml
from pyspark.sql import functions as F

from dyadic import reports
from dyadic.runs import artifacts, checks, config, matrix
from dyadic.runs.runner import dry_run, run_all, run_once
from dyadic.sources.tables import load_pairs, read_regression, read_summaries, write_canonical


def write_csv(path, header, rows):
    path.write_text("\n".join(",".join(map(str, r)) for r in [header, *rows]) + "\n")
    return str(path)


def flat_rows(label=False):
    return [(f"d{i}", "C" * (i + 1) + "NO"[i % 2], f"t{j}", "MKV" + "A" * j, (i + j) % 2 if label else round(0.1 + 0.1 * (i + j) / 2, 3))
            for i in range(5) for j in range(4)]


FLAT = ["Drug_ID", "Drug", "Target_ID", "Target"]


def make_config(folder, name, **sections):
    body = {"name": name, "protocol": "P0", "output": {"base_dir": str(folder / "out")}, **sections}
    path = folder / f"{name}.yaml"
    path.write_text(yaml.safe_dump(body))
    return str(path)


def test_regression_csv_keeps_last_value_and_first_text(spark, tmp_path):
    rows = [("10", "CC", "t1", "MK", "1.5"), ("10", "XX", "t1", "MK", "2.5"), ("2", "CN", "t1", "MK", "bad"),
            ("2", "CN", "t2", "VV", ""), ("3", "", "t2", "VV", "1"), ("2", "CN", "t2", "VV", " 4 ")]
    data = load_pairs(spark, "davis", write_csv(tmp_path / "x.csv", [*FLAT, "Y"], rows))
    assert {(r.a, r.b, r.y) for r in data.pairs.collect()} == {("10", "t1", 2.5), ("2", "t2", 4.0)}
    assert {r.key: r.content for r in data.left.collect()} == {"10": "CC", "2": "CN"}
    assert not data.meta["is_placeholder"]


def test_affinity_csv_identity_and_labels(spark, tmp_path):
    ids = load_pairs(spark, "BindingDB", write_csv(tmp_path / "i.csv", ["Drug_ID", "Target_ID", "Y"], [("a", "t", 10), ("b", "t", 1000)]))
    assert {(r.a, r.y) for r in ids.pairs.collect()} == {("a", 0.0), ("b", 1.0)}
    texts = load_pairs(spark, "bindingdb_kd", write_csv(
        tmp_path / "t.csv", ["Drug_ID", "Drug (SMILES)", "Target_ID", "Target (sequence)", "Label"],
        [("1", "CC", "5", "MK", 0), ("2", "CC", "5", "MK", 1), ("3", "", "5", "MK", 1)]))
    assert {(r.a, r.b, r.y) for r in texts.pairs.collect()} == {("CC", "MK", 1.0), ("", "MK", 1.0)}


def test_binary_csv_keeps_only_zero_and_one(spark, tmp_path):
    rows = [("a", "C", "t", "M", v) for v in (0,)] + [("b", "C", "t", "M", 2), ("c", "C", "t", "M", "1.0"), ("d", "C", "t", "M", "x")]
    data = load_pairs(spark, "KIBA", write_csv(tmp_path / "b.csv", [*FLAT, "Label"], rows), binary=True)
    assert {(r.a, r.y) for r in data.pairs.collect()} == {("a", 0.0), ("c", 1.0)}


def triplet(folder, left, right, lines):
    for name, content in (("drug_smiles.txt", left), ("target_sequences.txt", right), ("Y.txt", lines)):
        (folder / name).write_text("\n".join(content) + "\n")


def test_text_triplet(spark, tmp_path):
    triplet(tmp_path, ["CC", "", "CN"], ["MK", "VV", "LL"], ["1 2 3", "4  5 6"])
    data = load_pairs(spark, "DAVIS", str(tmp_path))
    assert sorted((r.a, r.b, r.y) for r in data.pairs.collect())[:4] == [("0", "0", 1.0), ("0", "1", 2.0), ("0", "2", 3.0), ("1", "0", 4.0)]
    assert {r.content for r in data.left.collect()} == {"CC", "CN"}
    triplet(tmp_path, ["CC", "CN"], ["MK"], ["1", "2"])
    assert load_pairs(spark, "DAVIS", str(tmp_path)).pairs.count() == 2


@pytest.mark.parametrize("case", ["nothing", "shape", "columns"])
def test_unusable_sources_give_the_placeholder(spark, tmp_path, case):
    if case == "shape":
        triplet(tmp_path, ["CC", "CN"], ["MK", "VV"], ["1 2 3", "4 5 6", "7 8 9"])
    if case == "columns":
        write_csv(tmp_path / "kiba.csv", ["BadCol1", "BadCol2"], [(1, 2)])
    data = load_pairs(spark, "kiba", str(tmp_path))
    assert data.meta["is_placeholder"] and data.pairs.count() == 4
    assert data.pairs.agg(F.sum("y")).first()[0] == pytest.approx(2.2)
    with pytest.raises(ValueError):
        load_pairs(spark, "other", str(tmp_path))


def test_csv_wins_over_triplet(spark, tmp_path):
    triplet(tmp_path, ["CC"], ["MK"], ["1"])
    write_csv(tmp_path / "davis.csv", [*FLAT, "Y"], flat_rows())
    assert load_pairs(spark, "DAVIS", str(tmp_path)).pairs.count() == 20


def test_validation_messages():
    good = {"name": "x", "protocol": "P", "output": {"base_dir": "o"}}
    assert config.validate(good) == []
    assert len(config.validate({})) == 3 and config.validate([]) == ["the configuration is not a mapping"]
    bad = {**good, "model": {"name": "nope", "latent_dim": 0, "hop_weights": []}, "split": {"test_ratio": 1.0, "strategy": "x"},
           "dataset": {"name": "zzz"}, "perturbation": {"strength": 2}, "causal": {"mode": "x", "weight": -1}, "binary": {"threshold": 3}}
    assert len(config.validate(bad)) == 10 and len(config.validate(bad, binary=True)) == 11
    assert config.validate({**good, "model": 3}) == ["section model is not a mapping"]


def test_exit_codes(spark, tmp_path):
    assert run_once(spark, str(tmp_path / "none.yaml")) == 1
    invalid = tmp_path / "invalid.yaml"
    invalid.write_text("name: x\n")
    assert run_once(spark, str(invalid)) == dry_run(str(invalid)) == 2
    strict = make_config(tmp_path, "strict", dataset={"name": "DAVIS", "path": str(tmp_path / "no"), "allow_placeholder": False})
    assert run_once(spark, strict) == 3 and dry_run(strict) == 0
    assert run_all(spark, [strict]) == 1


def test_run_without_data_writes_the_contract(spark, tmp_path):
    path = make_config(tmp_path, "stub", causal={"enabled": True})
    assert run_once(spark, path) == 0 and run_once(spark, path) == 0
    table = artifacts.registry(spark, str(tmp_path / "out"))
    rows = table.collect()
    assert [r["run_name"] for r in rows] == ["stub", "stub"] and table.columns == artifacts.REGISTRY_COLUMNS
    assert json.loads(open(rows[0]["summary_path"]).read())["causal_score"] == 0.5
    assert checks.validate_outputs(spark, [path]) == 0


def test_continuous_run_end_to_end(spark, tmp_path):
    source = write_csv(tmp_path / "davis.csv", [*FLAT, "Y"], flat_rows())
    path = make_config(
        tmp_path, "full", dataset={"name": "DAVIS", "path": source, "allow_placeholder": False},
        model={"name": "matrix_factorization", "latent_dim": 4, "epochs": 2}, split={"strategy": "cold_drug", "seed": 1},
        causal={"enabled": True, "mode": "unified", "mas_config": {"embedding_dim": 16}},
    )
    report = tmp_path / "check.json"
    assert checks.check_data(spark, path, str(report)) == 0
    assert json.loads(report.read_text())["source"]["num_data_rows"] == 20
    result = checks.gate([("run", lambda: run_once(spark, path)), ("outputs", lambda: checks.validate_outputs(spark, [path]))])
    assert result["overall_status"] == "PASS" and "| run | PASS | 0 |" in checks.gate_markdown(result)
    folder = artifacts.latest_run(spark, str(tmp_path / "out"), "full")
    summary = json.loads(artifacts.read_text(spark, f"{folder}/summary.json"))
    assert (summary["split"]["n_train"], summary["split"]["n_test"]) == (16, 4)
    assert summary["training"]["epochs_completed"] == 2 and 0 <= summary["causal_score"] <= 1
    assert spark.read.parquet(summary["prediction_path"]).count() == 20
    assert spark.read.parquet(summary["checkpoint_path"]).count() == 9
    found = read_summaries(spark, str(tmp_path / "out" / "runs" / "*" / "summary.json")).collect()
    assert [r.run_name for r in found] == ["full"] and found[0].rmse == pytest.approx(summary["evaluation_metrics"]["rmse"])


@pytest.mark.parametrize("mode", ["reliability", "cross_view", "mas", "irm_cf"])
def test_binary_run_in_every_mode(spark, tmp_path, mode):
    source = write_csv(tmp_path / "b.csv", [*FLAT, "Label"], flat_rows(label=True)[:-3])
    path = make_config(tmp_path, "bin", dataset={"name": "KIBA", "path": source}, split={"seed": 2},
                       causal={"enabled": True, "mode": mode, "weight": 1.0, "mas_config": {"embedding_dim": 16}})
    assert run_once(spark, path, binary=True) == 0
    summary = json.loads(artifacts.read_text(spark, artifacts.latest_run(spark, str(tmp_path / "out"), "bin") + "/summary.json"))
    assert summary["evaluation_metrics"]["n_evaluated"] == summary["split"]["n_test"] == 3
    assert 0 <= summary["causal_score"] <= 1 and summary["causal"]["mode"] == mode


def test_precheck_failures(spark, tmp_path):
    header_only = write_csv(tmp_path / "h.csv", ["Drug_ID", "Target_ID", "Y"], [])
    path = make_config(tmp_path, "h", dataset={"name": "BindingDB", "path": header_only})
    assert checks.check_data(spark, path) == 3
    wrong = write_csv(tmp_path / "w.csv", ["A", "B"], [(1, 2)])
    assert checks.check_data(spark, make_config(tmp_path, "w", dataset={"name": "BindingDB", "path": wrong})) == 3
    ok = write_csv(tmp_path / "o.csv", ["Drug", "Target", "Y"], [("CC", "MK", 3)])
    assert checks.check_data(spark, make_config(tmp_path, "o", dataset={"name": "BindingDB", "path": ok})) == 0
    assert checks.check_all(spark, [path]) == 1
    assert checks.validate_outputs(spark, [path]) == 1
    skipped = checks.gate([("a", lambda: 1), ("b", lambda: 0)])
    assert [s["status"] for s in skipped["steps"]] == ["FAIL", "SKIPPED"]


def test_matrix_configs():
    base = {"name": "b", "protocol": "P1", "output": {"base_dir": "o"}, "dataset": {"path": "p"}}
    made = matrix.matrix(matrix.regression_config, base, ["DAVIS"], ["random", "cold_drug"], ["full", "no_cf"], [10, 34, 42])
    assert len(made) == 12 and made[-1]["name"] == "PAIR_EVAL_DAVIS_COLD_DRUG_NO_CF_S42"
    assert made[-1]["causal"]["lambda_cf"] == 0.0 and all(config.validate(c) == [] for c in made)
    assert len(matrix.matrix(matrix.binary_config, base, ["KIBA"], ["random"], [1, 2, 3], max_runs=2)) == 2
    branch = matrix.branch_config({**base, "model": {"top_k": 3}}, "KIBA", "mixhop_baseline", 10)
    assert branch["model"]["top_k"] == 3 and branch["model"]["name"] == "mixhop_propagation"
    with pytest.raises(ValueError):
        matrix.apply_ablation({}, "other")


@pytest.mark.parametrize("name, expected", [
    ("PAIR_EVAL_DAVIS_RANDOM_FULL_S10", ("DAVIS", "RANDOM", "FULL", "10")),
    ("PAIR_EVAL_BINDINGDB_COLD_DRUG_NO_CF_S42", ("BINDINGDB", "COLD_DRUG", "NO_CF", "42")),
    ("PAIR_EVAL_KIBA_COLD_DRUG_SS7", ("KIBA", "COLD", "DRUG", "7")),
    ("PAIR_EVAL_KIBA_S7", ("UNKNOWN",) * 4),
])
def test_identity(spark, name, expected):
    row = reports.parse_regression_identity(spark.createDataFrame([(name,)], "run_name string")).first()
    assert (row.dataset, row.split, row.ablation, row.seed) == expected


def test_binary_identity_and_latest(spark):
    rows = [("PAIR_BINARY_EVAL_DAVIS_COLD_DRUG_S10", "a", "0.5"), ("PAIR_BINARY_EVAL_DAVIS_COLD_DRUG_S10", "b", "x"), ("short", "c", None)]
    runs = spark.createDataFrame(rows, "run_name string, summary_path string, auroc string")
    latest = reports.parse_binary_identity(reports.keep_latest(runs)).collect()
    assert {(r.summary_path, r.dataset, r.split, r.seed) for r in latest} == {("b", "DAVIS", "COLD_DRUG", "10"), ("c", "UNKNOWN", "UNKNOWN", "UNKNOWN")}
    means = reports.mean_by_group(reports.parse_binary_identity(runs), ["dataset"], ["auroc"]).collect()
    assert {(r.dataset, r.n_runs, r.auroc_mean) for r in means} == {("DAVIS", 2, 0.5), ("UNKNOWN", 1, None)}


def test_wide_export_refuses_too_many_columns(spark, tmp_path):
    scores = spark.createDataFrame([("a", "x", 0.25), ("a", "y", 0.5)], "a string, b string, y_hat double")
    path = artifacts.write_wide_predictions(str(tmp_path), scores)
    assert spark.read.option("header", True).csv(str(path)).first().asDict() == {"drug_id": "a", "x": "0.250000", "y": "0.500000"}
    with pytest.raises(ValueError):
        reports.pivot_predictions(scores, 1)
    with pytest.raises(RuntimeError):
        artifacts.write_factors(str(tmp_path), None)


def test_canonical_rows_survive_a_round_trip(spark, tmp_path):
    data = load_pairs(spark, "DAVIS", write_csv(tmp_path / "davis.csv", [*FLAT, "Y"], flat_rows()))
    write_canonical(data, str(tmp_path / "flat"))
    again = read_regression(spark, str(tmp_path / "flat"), "DAVIS")
    for mine, other in ((data.pairs, again.pairs), (data.left, again.left), (data.right, again.right)):
        assert mine.exceptAll(other).count() == 0 == other.exceptAll(mine).count()


def test_markdown_of_a_report(spark):
    table = spark.createDataFrame([("DAVIS", 0.123456), ("KIBA", None)], "dataset string, ci double").orderBy("dataset")
    assert reports.to_markdown(table, ["dataset", "ci"]).splitlines()[2:] == ["| DAVIS | 0.1235 |", "| KIBA | - |"]
    with pytest.raises(ValueError):
        reports.to_markdown(table, ["dataset"], 1)


def test_registry_keeps_rows_of_runs_that_end_at_once(spark, tmp_path):
    base = str(tmp_path)
    assert artifacts.registry(spark, base).count() == 0
    runs = [{"run_name": n, "status": s, "summary_path": f"{base}/runs/{n}_1/summary.json"} for n, s in (("x", "completed"), ("y", "failed"))]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda r: artifacts.register(spark, base, r), runs))
    artifacts.register(spark, base, runs[0])  # once more: still one row
    assert sorted((r.run_name, r.status) for r in artifacts.registry(spark, base).collect()) == [("x", "completed"), ("y", "failed")]
    assert sorted(r.run_name for r in artifacts.never_completed(spark, base, ["x", "y", "z"]).collect()) == ["y", "z"]


def test_run_scores_pairs_that_were_never_measured(spark, tmp_path):
    source = write_csv(tmp_path / "b.csv", [*FLAT, "Label"], flat_rows(label=True)[:-3])
    cells = write_csv(tmp_path / "cells.csv", ["Drug_ID", "Target_ID"], [("d4", "t3"), ("d0", "t0"), ("d4", "t3")])
    for model in ("simple_baseline", "matrix_factorization"):
        path = make_config(tmp_path, "more", dataset={"name": "KIBA", "path": source}, model={"name": model, "latent_dim": 3, "epochs": 2},
                           score={"pairs": cells, "top": 4})
        assert run_once(spark, path, binary=True) == 0
        summary = json.loads(artifacts.read_text(spark, artifacts.latest_run(spark, str(tmp_path / "out"), "more") + "/summary.json"))
        scored = {(r.a, r.b): r.y_hat for r in spark.read.parquet(summary["scored_pairs_path"]).collect()}
        assert set(scored) == {("d4", "t3"), ("d0", "t0")}
        top = {(r.a, r.b): (r["rank"], r.y_hat) for r in spark.read.parquet(summary["top_scores_path"]).collect()}
        known = {(r[0], r[2]) for r in flat_rows()[:-3]}
        assert top and not set(top) & known and top["d4", "t3"][1] == pytest.approx(scored["d4", "t3"], abs=1e-8)
    assert config.validate({"name": "x", "protocol": "P", "output": {"base_dir": "o"}, "model": {"name": "mixhop_propagation"}, "score": {"top": 3}})


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('Drug_ID,Drug,Target_ID,Target,Y\nd1,"C\nC",t1,MK,1\nd2,"say ""N""",t1,MK,2\n')
    data = load_pairs(spark, "davis", str(path))
    assert {r.key: r.content for r in data.left.collect()} == {"d1": "C\nC", "d2": 'say "N"'} and data.pairs.count() == 2
