"""What all predictors share: objectives, hyper-parameters, scoring targets.

A predictor is a function ``(data, targets, config) -> Prediction``. ``targets`` are the (a, b) cells to score;
``None`` means the known pairs, which is all that evaluation needs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadic.functions.numeric import clip
from dyadic.functions.text import hash_vector
from dyadic.operators.pairs import PairData
from dyadic.operators.skew import lookup
from dyadic.session import cut_lineage

# Accepted spellings of the objective.
OBJECTIVES = {
    "auto": "auto",
    "binary": "binary_classification",
    "binary_classification": "binary_classification",
    "classification": "binary_classification",
    "regression": "regression",
    "continuous": "regression",
}
BINARY = "binary_classification"


@dataclass
class Prediction:
    """Scored cells ``(a, b, y_hat)`` with what training left behind."""

    scores: DataFrame
    loss_history: list[float] = field(default_factory=list)
    factors: DataFrame | None = None  # (side, key, vec), saved as the checkpoint artifact


def normalize_objective(name: str | None) -> str:
    key = "auto" if name is None else str(name).strip().lower()
    if key not in OBJECTIVES:
        raise ValueError(f"unknown objective {name!r}; choose auto, binary_classification or regression")
    return OBJECTIVES[key]


def labels_look_binary(train: DataFrame, y: str = "y") -> DataFrame:
    """One row ``is_binary``: every label is close to 0 or 1 (false without labels)."""
    close = (F.abs(F.col(y)) <= 1e-8) | (F.abs(F.col(y) - 1.0) <= 1e-8 + 1e-5)
    return train.agg(F.coalesce(F.every(close), F.lit(False)).alias("is_binary"))


def clip_if_binary(score: Column, objective: str, train: DataFrame) -> Column:
    if objective == BINARY:
        return clip(score, 0.0, 1.0)
    if objective == "regression":
        return score
    return F.when(labels_look_binary(train).scalar(), clip(score, 0.0, 1.0)).otherwise(score)


def target_cells(data: PairData, targets: DataFrame | None) -> DataFrame:
    return (data.pairs if targets is None else targets).select("a", "b")


def hashed(entities: DataFrame, width: int = 16) -> DataFrame:
    """``(key, vec)`` character-hash features of the entities' content."""
    return entities.select("key", hash_vector(F.coalesce("content", F.lit("")), width).alias("vec"))


def hashed_sides(data: PairData) -> tuple[DataFrame, DataFrame]:
    """Character-hash features of both sides, found once for all pair tables over the same entities."""
    if "hashed" not in data.shared:
        data.shared["hashed"] = (cut_lineage(hashed(data.left)), cut_lineage(hashed(data.right)))
    return data.shared["hashed"]


def attach(data: PairData, cells: DataFrame, side: str, table: DataFrame) -> DataFrame:
    """Join an entity table (keyed ``key``) to the cells on side ``a`` or ``b``, hot entities salted."""
    other = "b" if side == "a" else "a"
    return lookup(cells, table.withColumnRenamed("key", side), side, data.hot[side], [other])
