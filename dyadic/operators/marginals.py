"""Means per left entity, per right entity and overall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.operators.pairs import PairData
from dyadic.operators.skew import lookup

EMPTY_MEAN = 0.5


def marginal_means(train: DataFrame) -> DataFrame:
    """All three kinds of mean in one pass: rows with b NULL, with a NULL, and with both NULL."""
    return train.groupingSets([[F.col("a")], [F.col("b")], []], "a", "b").agg(
        F.avg("y").alias("mean_y"), F.count("y").alias("n")
    )


def attach_marginals(data: PairData, targets: DataFrame) -> DataFrame:
    """Add ``row_mean``, ``col_mean`` and ``all_mean`` of the training pairs to target cells.

    Entities without training pairs fall back to the overall mean, an empty training set to 0.5.
    """
    train = data.train
    overall = F.coalesce(train.agg(F.avg("y")).scalar(), F.lit(EMPTY_MEAN))
    rows = train.groupBy("a").agg(F.avg("y").alias("row_mean"))
    cols = train.groupBy("b").agg(F.avg("y").alias("col_mean"))
    joined = lookup(lookup(targets, rows, "a", data.hot["a"], ["b"]), cols, "b", data.hot["b"], ["a"])
    return (
        joined.withColumn("all_mean", overall)
        .withColumn("row_mean", F.coalesce("row_mean", "all_mean"))
        .withColumn("col_mean", F.coalesce("col_mean", "all_mean"))
    )
