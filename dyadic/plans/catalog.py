"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dyadic.operators.regression_metrics import evaluate_regression
from dyadic.plans import data_queries, feature_queries, model_queries, report_queries  # noqa: F401  (register their queries)
from dyadic.plans.inputs import item_data
from dyadic.plans.registry import ORACLES, QUERIES  # noqa: F401
from dyadic.predictors.factory import create_predictor


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    data = item_data(spark, folder)
    scores = create_predictor("simple_baseline")(data).scores
    test = data.pairs.where("fold = 'test'").select("a", "b", "y")
    return evaluate_regression(scores.join(test, ["a", "b"]))
