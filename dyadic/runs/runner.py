"""One run from configuration to registry, for continuous values and for binary labels."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

import yaml
from pyspark.sql import SparkSession

from dyadic.operators.binary_metrics import evaluate_binary
from dyadic.operators.pairs import PairData, densify, grid
from dyadic.operators.regression_metrics import evaluate_regression
from dyadic.operators.robustness import placeholder_score, prediction_stats
from dyadic.operators.splits import split_pairs
from dyadic.predictors.base import Prediction
from dyadic.predictors.factory import create_predictor
from dyadic.predictors.retrieval import top_unmeasured
from dyadic.runs import artifacts
from dyadic.runs.config import model_name, validate, vector_settings
from dyadic.runs.diagnostics import diagnose
from dyadic.session import cut_lineage
from dyadic.sources.tables import load_pairs, read_cells, stored_vectors

# Exit codes.
OK, NO_CONFIG, BAD_CONFIG, STRICT_PLACEHOLDER = 0, 1, 2, 3


def read_config(path: str, binary: bool = False) -> tuple[int, dict]:
    """Exit code and configuration; complaints are printed."""
    if not Path(path).exists():
        print(f"[ERROR] no configuration at {path}")
        return NO_CONFIG, {}
    config = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    errors = validate(config, binary)
    for error in errors:
        print(f"[ERROR] {error}")
    return (BAD_CONFIG if errors else OK), config


def dry_run(path: str, binary: bool = False) -> int:
    """Validate and echo what would run."""
    code, config = read_config(path, binary)
    if code == OK:
        print("[OK] configuration is valid")
        for name, value in (("name", config["name"]), ("protocol", config["protocol"]), ("model.name", model_name(config)),
                            ("dataset", (config.get("dataset") or {}).get("path")), ("output", config["output"]["base_dir"])):
            print(f"{name}={value}")
    return code


def _split_of(config: dict) -> dict | None:
    split = config.get("split")
    if not split:
        return None
    return {"strategy": split.get("strategy", "random"), "test_ratio": float(split.get("test_ratio", 0.2)), "seed": int(split.get("seed", 42))}


def _dense(data: PairData) -> PairData:
    """Zero-filled grid: continuous sources count every cell as known."""
    cells = grid(data.left, data.right)
    return data.with_pairs(cut_lineage(densify(cells, data.pairs, "zero")))


def _model(spark: SparkSession, config: dict) -> dict:
    model = vector_settings(config.get("model") or {})
    for key in ("left_vectors", "right_vectors"):
        model[key] = stored_vectors(spark, model.get(key))
    return model


def run_once(spark: SparkSession, path: str, binary: bool = False) -> int:
    code, config = read_config(path, binary)
    if code != OK:
        return code
    dataset, data = config.get("dataset"), None
    if dataset:
        data = load_pairs(spark, dataset["name"], str(dataset["path"]), binary)
        if data.meta["is_placeholder"] and not dataset.get("allow_placeholder", True):
            print(f"[ERROR] strict mode: no usable source at {dataset['path']}")
            return STRICT_PLACEHOLDER
    base, name = str(config["output"]["base_dir"]), config["name"]
    folder = artifacts.open_run(spark, base, name)
    summary = {"run_name": name, "protocol": config["protocol"], "status": "completed",
               "created_at": datetime.now().isoformat(timespec="seconds")}
    causal = config.get("causal") or {}
    if data is None:
        score = placeholder_score(bool(causal.get("enabled", False)))
        if score is not None:
            summary["causal_score"] = score
    else:
        summary.update(_run_data(spark, config, data, folder, binary))
    paths = artifacts.write_documents(spark, folder, summary, config)
    artifacts.register(spark, base, {**summary, **paths})
    print(f"[OK] run completed: {paths['summary_path']}")
    return OK


def _run_data(spark: SparkSession, config: dict, data: PairData, folder: str, binary: bool) -> dict:
    is_placeholder = data.meta["is_placeholder"]
    dataset = config["dataset"]
    fill = dataset.get("fill", "null" if binary else "zero")
    data = data.with_pairs(cut_lineage(data.pairs))
    if fill == "zero" and not is_placeholder and not data.meta.get("all_cells_listed"):
        data = _dense(data)
    split = _split_of(config)
    if split and (binary or not is_placeholder):
        data = data.with_pairs(cut_lineage(split_pairs(data.pairs, **split)))
    else:
        split = None
    predictor = create_predictor(_model(spark, config))
    found = predictor(data)
    scores = cut_lineage(found.scores)
    out = {
        "dataset_name": data.meta["source"], "dataset_placeholder": is_placeholder,
        "dataset_allow_placeholder": dataset.get("allow_placeholder", True),
        "num_drugs": data.left.count(), "num_targets": data.right.count(),
        "prediction_path": artifacts.write_table(folder, artifacts.PREDICTIONS, scores.select("a", "b", "y_hat")),
        "prediction_stats": prediction_stats(scores).first().asDict(),
    }
    if binary:
        out["task_type"] = "binary_classification"
        out["binary_threshold"] = float((config.get("binary") or {}).get("threshold", 0.5))

    def evaluate(fold: str | None) -> dict:
        known = data.pairs if fold is None else data.pairs.where(f"fold = '{fold}'")
        rows = scores.join(known.select("a", "b", "y"), ["a", "b"])
        if binary:
            return evaluate_binary(rows, ["a", "b"], out["binary_threshold"]).first().asDict()
        return evaluate_regression(rows).first().asDict()

    if split:
        counts = {r.fold: r["count"] for r in data.pairs.groupBy("fold").count().collect()}
        out["split"] = {**split, "n_train": counts.get("train", 0), "n_test": counts.get("test", 0)}
        out["evaluation_metrics"], out["train_metrics"] = evaluate("test"), evaluate("train")
    else:
        out["evaluation_metrics"] = evaluate(None)
    if found.loss_history:
        losses = found.loss_history
        out["training"] = {"epochs_completed": len(losses), "loss_start": round(losses[0], 6),
                           "loss_final": round(losses[-1], 6), "loss_min": round(min(losses), 6)}
    if found.factors is not None:
        out["checkpoint_path"] = artifacts.write_factors(folder, found.factors)
    out.update(_unmeasured(spark, config, data, found, predictor, folder))
    causal = config.get("causal") or {}
    if causal.get("enabled", False):
        out.update(diagnose(data, scores, causal, config.get("perturbation"), predictor))
    return out


def _unmeasured(spark: SparkSession, config: dict, data: PairData, found: Prediction, predictor, folder: str) -> dict:
    """Scores beyond the known pairs: of a table of cells (``score.pairs``), and of the best ones (``score.top``)."""
    wanted, out = config.get("score") or {}, {}
    if wanted.get("pairs"):
        cells = read_cells(spark, wanted["pairs"])
        out["scored_pairs_path"] = artifacts.write_table(folder, artifacts.SCORED_PAIRS, predictor(data, cells).scores.select("a", "b", "y_hat"))
    if wanted.get("top"):
        best = top_unmeasured(data, model_name(config), found, int(wanted["top"]))
        out["top_scores_path"] = artifacts.write_table(folder, artifacts.TOP_SCORES, best)
    return out


def run_all(spark: SparkSession, paths: list[str], binary: bool = False) -> int:
    """Run every configuration in one session; 1 if any of them failed."""
    codes = {path: run_once(spark, path, binary) for path in paths}
    for path, code in codes.items():
        print(f"{'PASS' if code == OK else 'FAIL'} {code} {path}")
    return int(any(code != OK for code in codes.values()))
