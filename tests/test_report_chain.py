"""Reports compiled from summaries in one call."""

import json

from dyadic.reports import chain
from dyadic.runs.__main__ import main


def summary(folder, name, stamp, **metrics):
    path = folder / "runs" / f"{name}_{stamp}"
    path.mkdir(parents=True)
    (path / "summary.json").write_text(json.dumps({"run_name": name, "status": "completed", "evaluation_metrics": metrics}))


def lines(path):
    return [line for part in sorted(p for p in path.iterdir() if p.name.startswith("part-")) for line in part.read_text().splitlines()]


def world(tmp_path):
    summary(tmp_path, "PAIR_EVAL_KIBA_RANDOM_FULL_S10", "20250101_000000", ci=0.1, rmse=9.0)
    summary(tmp_path, "PAIR_EVAL_KIBA_RANDOM_FULL_S10", "20250102_000000", ci=0.6, rmse=1.0)  # the newer one counts
    summary(tmp_path, "PAIR_EVAL_KIBA_RANDOM_FULL_S42", "20250101_000000", ci=0.8)
    summary(tmp_path, "PAIR_EVAL_DAVIS_COLD_DRUG_NO_CF_S10", "20250101_000000", ci=0.5, rmse=2.0)
    summary(tmp_path, "PAIR_BINARY_EVAL_DAVIS_RANDOM_S10", "20250101_000000", auroc=0.75, f1=0.5)
    broken = tmp_path / "runs" / "broken_1"
    broken.mkdir()
    (broken / "summary.json").write_text("{not json")


def test_regression_reports(spark, tmp_path):
    world(tmp_path)
    paths = chain.compile_reports(spark, str(tmp_path / "runs" / "*" / "summary.json"), str(tmp_path / "out"), "PAIR_EVAL")
    detailed = spark.read.option("header", True).csv(paths["detailed"])
    assert detailed.columns == chain.REGRESSION_COLUMNS and detailed.count() == 3
    assert lines(tmp_path / "out" / "markdown") == [
        "| dataset | split | ablation | n_runs | ci_mean | rmse_mean | pearson_mean | spearman_mean |",
        "| --- | --- | --- | --- | --- | --- | --- | --- |",
        "| DAVIS | COLD_DRUG | NO_CF | 1 | 0.5000 | 2.0000 | - | - |", "| KIBA | RANDOM | FULL | 2 | 0.7000 | 1.0000 | - | - |"]
    assert spark.read.option("header", True).csv(paths["aggregate"]).count() == 2


def test_binary_reports_from_the_command_line(spark, tmp_path):
    world(tmp_path)
    assert main(["--report", str(tmp_path / "runs"), "--out", str(tmp_path / "out"), "--prefix", "PAIR_BINARY", "--binary"]) == 0
    assert lines(tmp_path / "out" / "markdown")[2:] == ["| DAVIS | RANDOM | 1 | 0.7500 | - | 0.5000 | - | - | - | - |"]


def test_no_runs_give_headed_empty_reports(spark, tmp_path):
    world(tmp_path)
    paths = chain.compile_reports(spark, str(tmp_path / "runs" / "*" / "summary.json"), str(tmp_path / "out"), "NOTHING")
    assert len(lines(tmp_path / "out" / "markdown")) == 2 and spark.read.option("header", True).csv(paths["detailed"]).count() == 0


def test_tasks_side_by_side(spark, tmp_path):
    world(tmp_path)
    names = spark.createDataFrame([("PAIR_EVAL_KIBA_RANDOM_FULL_S10", "regression", "KIBA"), ("PAIR_BINARY_EVAL_DAVIS_RANDOM_S10", "binary", "DAVIS"),
                                   ("PAIR_EVAL_KIBA_RANDOM_FULL_S99", "regression", "KIBA")], "name string, task string, dataset string")
    paths = chain.compare_tasks(spark, str(tmp_path / "runs" / "*" / "summary.json"), names, str(tmp_path / "out"))
    rows = spark.read.option("header", True).csv(paths["comparison"]).collect()
    assert [(r.dataset, r.task, r.auroc, r.ci) for r in rows] == [("DAVIS", "binary", "0.75", None), ("KIBA", "regression", None, "0.6")]
    assert len(lines(tmp_path / "out" / "comparison_markdown")) == 4
