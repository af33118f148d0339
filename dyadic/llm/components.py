"""Connected components of an edge table by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) for the nodes of ``edges`` (a, b); the label is the smallest node of the component.

    Each round takes the smallest label among a node and its neighbours and then the label of that label, so the number
    of rounds follows the logarithm of the longest path for chains of labels. Every round is a written table.
    """
    edges = cut_lineage(edges.select("a", "b").where("a <> b"))
    both = cut_lineage(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = cut_lineage(lower.join(jump, "next", "left").select("node", "label", F.least("next", "far").alias("new")))
        if moved.where("new <> label").limit(1).count() == 0:
            return labels
        labels = moved.select("node", F.col("new").alias("label"))
