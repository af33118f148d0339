"""A training-data pipeline over ``documents``: five stages, each one operator of ``dyadic.llm``.

Nulls, empty texts, repeated rows, empty tables and further columns are treated as the operators' docstrings say.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns the columns of documents
(the last adds the mixing columns). ``run`` writes each result as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.llm.decontamination import decontaminate
from dyadic.llm.line_dedup import dedup_lines
from dyadic.llm.mixing import mix_sources
from dyadic.llm.ngram_join import one_of_each_class
from dyadic.llm.quality import score_quality, train
from dyadic.plans.inputs import table
from dyadic.session import cut_lineage

QUALITY = 0.7
MIXED = ["tokens", "weight", "pass", "place"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores below ``QUALITY`` go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model, docs.columns).where(F.col("found.score") >= QUALITY)
    return scored.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows are cut out; documents that consist of repeats alone go. n_chars follows the text."""
    found = dedup_lines(docs).where((F.col("n_removed") == 0) | (F.trim("kept") != ""))
    value = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[value.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; lesser passages of benchmark items are cut out."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passes over the sources that realise the tempered weights; every document is in one pass at least.

    Columns of the documents that are named like one of ``MIXED`` give way to the result.
    """
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in MIXED]
    return mix_sources(docs).select(*own, *MIXED)


STAGES = [
    ("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
    ("decontamination", decontamination), ("mixing", mixing),
]
ORACLE_SQL = None  # the classifier is not SQL; tests compare the stages with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
