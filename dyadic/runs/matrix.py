"""Configurations of an experiment matrix."""

from __future__ import annotations

import copy

from dyadic.reports import ABLATIONS

REGRESSION_PREFIX, BINARY_PREFIX = "PAIR_EVAL", "PAIR_BINARY_EVAL"
# The branches that are compared and the model settings they start from.
BRANCHES = {
    "mixhop_baseline": {"name": "mixhop_propagation", "top_k": 8, "hop_weights": [0.6, 0.3, 0.1]},
    "interaction_cross_attn": {"name": "interaction_cross_attention", "latent_dim": 16, "epochs": 5, "lr": 0.01,
                               "attention_temperature": 1.0, "top_k": 8},
}


def apply_ablation(causal: dict, ablation: str) -> dict:
    """Unified diagnostics with at most one term switched off."""
    if ablation not in ABLATIONS:
        raise ValueError(f"unknown ablation {ablation!r}; choose one of {', '.join(ABLATIONS)}")
    out = {**causal, "enabled": True, "mode": "unified"}
    out.update({f"lambda_{term}": 1.0 for term in ("xview", "mas", "irm", "cf")})
    if ABLATIONS[ablation]:
        out[ABLATIONS[ablation]] = 0.0
    return out


def _with_seed(base: dict, dataset: str, split: str, seed: int, path: str | None) -> dict:
    out = copy.deepcopy(base)
    out["dataset"] = {**out.get("dataset", {}), "name": dataset, "allow_placeholder": False}
    if path is not None:
        out["dataset"]["path"] = path
    out["split"] = {"test_ratio": 0.2, **out.get("split", {}), "strategy": split, "seed": seed}
    for section in ("model", "perturbation"):
        out[section] = {**(out.get(section) or {}), "seed": seed}
    return out


def regression_config(base: dict, dataset: str, split: str, ablation: str, seed: int, path: str | None = None) -> dict:
    out = _with_seed(base, dataset, split, seed, path)
    out["name"] = f"{REGRESSION_PREFIX}_{dataset}_{split}_{ablation}_S{seed}".upper()
    out["causal"] = apply_ablation(out.get("causal") or {}, ablation)
    for section in ("sequence_model", "mas_config", "irm_cf_config"):
        if isinstance(out["causal"].get(section), dict):
            out["causal"][section]["seed"] = seed
    return out


def binary_config(base: dict, dataset: str, split: str, seed: int, path: str | None = None) -> dict:
    out = _with_seed(base, dataset, split, seed, path)
    out["name"] = f"{BINARY_PREFIX}_{dataset}_{split}_S{seed}".upper()
    return out


def branch_config(base: dict, dataset: str, branch: str, seed: int) -> dict:
    if branch not in BRANCHES:
        raise ValueError(f"unknown branch {branch!r}; choose one of {', '.join(BRANCHES)}")
    out = _with_seed(base, dataset, (base.get("split") or {}).get("strategy", "random"), seed, None)
    out["model"] = {**BRANCHES[branch], **out["model"], "name": BRANCHES[branch]["name"]}
    out["name"] = f"PAIR_{dataset}_{branch}_PARITY_S{seed}".upper()
    return out


def matrix(build, base: dict, *factors: list, max_runs: int | None = None) -> list[dict]:
    """All settings of the factors in order, cut to ``max_runs`` if asked."""
    settings = [[]]
    for values in factors:
        settings = [s + [v] for s in settings for v in values]
    return [build(base, *s) for s in (settings if max_runs is None else settings[:max_runs])]
