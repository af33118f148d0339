"""Queries of the quality classifier and the neighbour search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.llm.neighbours import nearest_neighbours
from dyadic.llm.quality import held_out, score_quality, train
from dyadic.llm.registry import query
from dyadic.plans.inputs import table

THRESHOLD = 0.7


@query("op2_quality")
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, table(spark, folder, "labels"))
    found = score_quality(docs, model, ["doc_id"]).select("row.doc_id", "found.score")
    return found.select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op10_neighbours")
def op10_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)
