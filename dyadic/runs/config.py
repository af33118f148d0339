"""Validation of run configurations: a table of rules, and a list of messages as the result."""

from __future__ import annotations

from dyadic.operators.splits import STRATEGIES
from dyadic.predictors.base import OBJECTIVES
from dyadic.predictors.factory import DEFAULT_MODEL, PREDICTORS
from dyadic.sources.tables import SOURCES

CAUSAL_MODES = ["reliability", "cross_view", "mas", "irm_cf", "unified"]


def _number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _integer(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def _at_least(low):
    return lambda v: _integer(v) and v >= low


def _named(options):
    known = {str(o).lower() for o in options}
    return lambda v: isinstance(v, str) and v.strip().lower() in known


def _text_or_none(value) -> bool:
    return value is None or isinstance(value, str)


def _positive(value) -> bool:
    return _number(value) and value > 0


def _unit_range(value) -> bool:
    return _number(value) and 0 <= value <= 1


# section -> key -> (test, what is wanted); only keys that are present are tested.
RULES = {
    "dataset": {
        "name": (_named(SOURCES), f"one of {', '.join(SOURCES)}"),
        "allow_placeholder": (lambda v: isinstance(v, bool), "a boolean"),
        "fill": (lambda v: v is None or _named(["zero", "null"])(v), "zero or null"),
    },
    "model": {
        "name": (_named(PREDICTORS), f"one of {', '.join(sorted(PREDICTORS))}"),
        "latent_dim": (_at_least(1), "a positive integer"),
        "epochs": (_at_least(1), "a positive integer"),
        "top_k": (_at_least(1), "a positive integer"),
        "lr": (_positive, "a positive number"),
        "attention_temperature": (_positive, "a positive number"),
        "seed": (_integer, "an integer"),
        "hop_weights": (lambda v: isinstance(v, list) and bool(v) and all(_number(w) and w >= 0 for w in v),
                        "a non-empty list of non-negative numbers"),
        "objective": (_named(OBJECTIVES), "auto, binary_classification or regression"),
        "left_vectors": (_text_or_none, "a path or null"),
        "right_vectors": (_text_or_none, "a path or null"),
        "chemberta_npz_path": (_text_or_none, "a path or null"),
        "ankh_npz_path": (_text_or_none, "a path or null"),
        "fusion_alpha": (_unit_range, "a number in [0, 1]"),
        "max_calibration_samples": (_at_least(1000), "an integer of at least 1000"),
        "embedding_dim": (_at_least(8), "an integer of at least 8"),
        "max_drug_len": (_at_least(8), "an integer of at least 8"),
        "max_target_len": (_at_least(8), "an integer of at least 8"),
        "l2": (lambda v: _number(v) and v >= 0, "a non-negative number"),
    },
    "perturbation": {
        "strength": (_unit_range, "a number in [0, 1]"),
        "seed": (_integer, "an integer"),
    },
    "split": {
        "strategy": (_named(STRATEGIES), f"one of {', '.join(sorted(STRATEGIES))}"),
        "test_ratio": (lambda v: _number(v) and 0 < v < 1, "a number strictly between 0 and 1"),
        "seed": (_integer, "an integer"),
    },
    "causal": {
        "enabled": (lambda v: isinstance(v, bool), "a boolean"),
        "weight": (lambda v: _number(v) and v >= 0, "a non-negative number"),
        "mode": (_named(CAUSAL_MODES), f"one of {', '.join(CAUSAL_MODES)}"),
        "sequence_model": (lambda v: isinstance(v, dict), "a mapping"),
        "graph_model": (lambda v: isinstance(v, dict), "a mapping"),
    },
    "score": {
        "pairs": (_text_or_none, "a path or null"),
        "top": (lambda v: v is None or _at_least(1)(v), "a positive integer or null"),
    },
    "binary": {"threshold": (_unit_range, "a number in [0, 1]")},
}
# Models whose score grows with an inner product of entity vectors.
SEARCHABLE = ("simple_baseline", "matrix_factorization")
REQUIRED = {"dataset": ["name", "path"]}
# Keys that are read without a rule of their own.
UNRULED = {
    "dataset": {"path"},
    "model": {"drug_embedding_path", "target_embedding_path"},  # accepted, and without effect on any model
    "causal": {"lambda_xview", "lambda_mas", "lambda_irm", "lambda_cf", "mas_config", "irm_cf_config"},
}
# Other names of the settings for stored vectors, and the settings they stand for.
VECTOR_NAMES = {"chemberta_npz_path": "left_vectors", "ankh_npz_path": "right_vectors",
                "drug_npz_path": "drug_vectors", "prot_npz_path": "prot_vectors"}
NESTED = {
    "mas_config": {"embedding_dim", "mask_ratio", "seed", "weight", *VECTOR_NAMES, *VECTOR_NAMES.values()},
    "irm_cf_config": {"n_envs", "pos_threshold", "n_cf_pairs", "irm_weight", "cf_weight", "seed", "weight"},
}


def check_section(name: str, section) -> list[str]:
    if section is None:
        return []
    if not isinstance(section, dict):
        return [f"section {name} is not a mapping"]
    errors = [f"{name}.{key} is required" for key in REQUIRED.get(name, []) if not section.get(key)]
    for key, (accepted, wanted) in RULES[name].items():
        if key in section and f"{name}.{key} is required" not in errors and not accepted(section[key]):
            errors.append(f"{name}.{key} must be {wanted}")
    errors += [f"{name}.{key} is not a setting of this section" for key in section if key not in RULES[name] and key not in UNRULED.get(name, ())]
    for nested, known in NESTED.items() if name == "causal" else ():
        inner = section.get(nested)
        if isinstance(inner, dict):
            errors += [f"{name}.{nested}.{key} is not a setting of this section" for key in inner if key not in known]
    return errors


def vector_settings(section: dict) -> dict:
    """The section with stored vectors under their own names."""
    renamed = {VECTOR_NAMES.get(k, k): v for k, v in section.items() if v is not None or k not in VECTOR_NAMES}
    return renamed | {k: v for k, v in section.items() if k not in VECTOR_NAMES and v is not None}


def validate(config, binary: bool = False) -> list[str]:
    """Messages about everything that is wrong; an empty list means the configuration can run."""
    if not isinstance(config, dict):
        return ["the configuration is not a mapping"]
    errors = [f"missing required key: {key}" for key in ("name", "protocol") if not config.get(key)]
    output = config.get("output")
    if not isinstance(output, dict) or not output.get("base_dir"):
        errors.append("missing required key: output.base_dir")
    for name in RULES:
        if name != "binary" or binary:
            errors += check_section(name, config.get(name))
    score = config.get("score")
    if isinstance(score, dict) and score.get("top") and model_name(config) not in SEARCHABLE:
        errors.append(f"score.top needs one of the models {', '.join(SEARCHABLE)}")
    return errors


def model_name(config: dict) -> str:
    model = config.get("model")
    return str((model if isinstance(model, dict) else {}).get("name", DEFAULT_MODEL)).strip().lower()
