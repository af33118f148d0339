"""Predictors by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from dyadic.predictors import attention, char_encoder, dual_view, factorization, mixhop, simple
from dyadic.predictors.base import normalize_objective

# Model names as they appear in run configurations.
PREDICTORS = {
    "simple_baseline": simple.predict,
    "dual_frozen_backbone": dual_view.predict,
    "matrix_factorization": factorization.predict,
    "mixhop_propagation": mixhop.predict,
    "interaction_cross_attention": attention.predict,
    "end_to_end_char_encoder": char_encoder.predict,
}
DEFAULT_MODEL = "simple_baseline"


def create_predictor(model: str | dict | None) -> Callable:
    """``predict(data, targets=None)`` for a model name or a model section of a run configuration."""
    config = dict(model) if isinstance(model, dict) else {}
    name = config.get("name", DEFAULT_MODEL) if isinstance(model, dict) else (model or DEFAULT_MODEL)
    key = str(name).strip().lower()
    if key not in PREDICTORS:
        raise ValueError(f"unknown model {name!r}; choose one of {', '.join(PREDICTORS)}")
    if "objective" in config:
        normalize_objective(config["objective"])
    return partial(PREDICTORS[key], config=config)
