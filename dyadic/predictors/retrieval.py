"""Best unmeasured right entities of every left entity, for models whose score grows with an inner product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.functions.numeric import clip, sigmoid
from dyadic.operators.pairs import PairData
from dyadic.operators.retrieval import top_unknown
from dyadic.predictors import factorization, simple
from dyadic.predictors.base import Prediction


def _factor_sides(found: Prediction) -> tuple[DataFrame, DataFrame]:
    return tuple(found.factors.where(F.col("side") == side).select("key", "vec", F.lit(0.0).alias("bias")) for side in ("a", "b"))


def top_unmeasured(data: PairData, name: str, found: Prediction, k: int) -> DataFrame:
    """(a, b, rank, y_hat): per left entity the ``k`` best right entities among the pairs that are not in ``data.pairs``.

    The order is that of the score before it is bounded to its range, so entities that reach the bound stay apart.
    """
    if name == "simple_baseline":
        left, right = simple.score_vectors(data)
        bounded = clip(F.col("score"), 0.0, 1.0)
    elif name == "matrix_factorization":
        left, right = _factor_sides(found)
        bounded = sigmoid(F.col("score"), factorization.SCORE_BOUND)
    else:
        raise ValueError(f"{name} has no inner product to search by; name the pairs to score in score.pairs")
    best = top_unknown(left, right, data.pairs, k, data.hot["b"])
    return best.select("a", "b", "rank", bounded.alias("y_hat"))
