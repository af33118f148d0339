"""Diagnostics of a finished run, by mode. They follow prediction and never feed back into training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.operators import robustness
from dyadic.operators.pairs import PairData
from dyadic.predictors.dual_view import lookup_embeddings
from dyadic.predictors.factory import create_predictor
from dyadic.runs.config import vector_settings
from dyadic.session import cut_lineage
from dyadic.sources.tables import stored_vectors

SEQUENCE_MODEL, GRAPH_MODEL = {"name": "dual_frozen_backbone"}, {"name": "mixhop_propagation"}
VECTOR_WIDTH = 768


def _row(frame: DataFrame) -> dict:
    return frame.first().asDict()


def _views(data: PairData, shaken: PairData, config: dict) -> list[DataFrame]:
    models = [config.get("sequence_model", SEQUENCE_MODEL), config.get("graph_model", GRAPH_MODEL)]
    return [cut_lineage(create_predictor(m)(d).scores) for d in (data, shaken) for m in models]


def _vectors(data: PairData, config: dict) -> tuple[DataFrame, DataFrame]:
    config = vector_settings(config)
    width = int(config.get("embedding_dim", VECTOR_WIDTH))
    found = []
    for entities, key in ((data.left, "drug_vectors"), (data.right, "prot_vectors")):
        table = stored_vectors(entities.sparkSession, config.get(key))
        found.append(cut_lineage(lookup_embeddings(entities, table, width).select("vec")))
    return found[0], found[1]


def _swap_settings(config: dict) -> dict:
    kinds = {"n_envs": int, "pos_threshold": float, "n_cf_pairs": int, "irm_weight": float, "cf_weight": float, "seed": int}
    return {key: kind(config[key]) for key, kind in kinds.items() if key in config}


def diagnose(data: PairData, scores: DataFrame, config: dict, perturbation: dict | None = None, predictor=None) -> dict:
    """``{"causal": {...}, "causal_score": x}`` for the configured mode; unknown modes mean reliability."""
    mode = str(config.get("mode", "reliability")).strip().lower()
    weight = float(config.get("weight", 0.0))
    weight = weight if weight > 0 else 1.0
    settings = perturbation or {}
    shaken = data.with_pairs(cut_lineage(
        robustness.perturb(data.pairs, settings.get("strength", 0.1), settings.get("seed", 42))
    ))
    scored = scores.join(data.pairs.select("a", "b", "y"), ["a", "b"])
    mas = config.get("mas_config", {})
    swaps = _swap_settings(config.get("irm_cf_config", {}))
    model = predictor or create_predictor(None)
    score = lambda cells: model(data, cells).scores

    if mode == "cross_view":
        found = _row(robustness.cross_view(*_views(data, shaken, config), weight))
        return {"causal": {"mode": mode, "metrics": found}, "causal_score": found["causal_score"]}
    if mode == "mas":
        left, right = _vectors(data, mas)
        found = robustness.reconstruction_score(left, right, float(mas.get("mask_ratio", 0.15)), int(mas.get("seed", 42)), weight)
        return {"causal": {"mode": mode, "metrics": found}, "causal_score": found["mas_score"]}
    if mode == "irm_cf":
        found = _row(robustness.swap_and_environment(cut_lineage(scored), data.right, score, **swaps))
        return {"causal": {"mode": mode, "metrics": found}, "causal_score": found["irm_cf_score"]}
    if mode == "unified":
        # A zero lambda leaves its term out, so the models behind it are not run at all.
        lam = {name: float(config.get(f"lambda_{name}", 1.0)) for name in ("xview", "mas", "irm", "cf")}
        losses = {"l_xview": 0.0, "l_mas": 0.0, "l_irm": 0.0, "l_cf": 0.0}
        if lam["xview"] > 0:
            losses["l_xview"] = _row(robustness.cross_view(*_views(data, shaken, config)))["l_xview"]
        if lam["mas"] > 0:
            found = robustness.reconstruction_score(*_vectors(data, mas), float(mas.get("mask_ratio", 0.15)), int(mas.get("seed", 42)))
            losses["l_mas"] = found["l_mas"]
        if lam["irm"] > 0 or lam["cf"] > 0:
            found = _row(robustness.swap_and_environment(cut_lineage(scored), data.right, score, **swaps))
            losses.update(l_irm=found["l_irm"], l_cf=found["l_cf"])
        frame = scores.sparkSession.createDataFrame([tuple(map(float, losses.values()))], ", ".join(f"{k} double" for k in losses))
        found = _row(robustness.unified(frame, {f"lambda_{k}": v for k, v in lam.items()}))
        return {"causal": {"mode": mode, "lambdas": lam, "metrics": found}, "causal_score": found["unified_causal_score"]}
    again = model(shaken).scores
    value = robustness.reliability(scores, again, weight).select(F.col("reliability")).first()[0]
    return {"causal": {"mode": "reliability", "metric": "prediction_stability"}, "causal_score": value}
