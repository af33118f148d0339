"""From run summaries to written reports in one call.

Summaries are read, the newest of each run name stays, and identity, per-run table, means over seeds and their Markdown
follow. Every table is written by Spark, in report order, whatever its length; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic import reports
from dyadic.sources.tables import read_summaries

# Columns of the per-run tables.
REGRESSION_COLUMNS = ["run_name", "dataset", "split", "ablation", "seed", "status", *reports.REGRESSION_METRICS, "causal_score", "l_total", "summary_path"]
BINARY_COLUMNS = ["run_name", "dataset", "split", "seed", "status", *reports.BINARY_METRICS, "summary_path"]


def run_tables(runs: DataFrame, prefix: str, binary: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per-run table of the newest runs whose name has the prefix, and its means over seeds."""
    latest = reports.keep_latest(reports.with_prefix(runs, prefix))
    if binary:
        named = reports.parse_binary_identity(latest)
        return named.select(*BINARY_COLUMNS), reports.mean_by_group(named, ["dataset", "split"], reports.BINARY_METRICS)
    named = reports.parse_regression_identity(latest)
    return named.select(*REGRESSION_COLUMNS), reports.mean_by_group(named, ["dataset", "split", "ablation"], reports.REGRESSION_METRICS)


def shown(table: DataFrame, column: str) -> Column:
    """A cell: four decimals for fractional numbers, a dash for NULL, bars escaped."""
    if table.schema[column].dataType.typeName() in ("double", "float"):
        return reports.show_metric(column)
    return F.coalesce(F.replace(F.col(column).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("-"))


def markdown_rows(table: DataFrame, columns: list[str]) -> DataFrame:
    """``table`` with ``line``, its row as a Markdown table row."""
    cells = F.concat_ws(" | ", *[shown(table, c) for c in columns])
    return table.withColumn("line", F.concat(F.lit("| "), cells, F.lit(" |")))


def write_markdown(table: DataFrame, columns: list[str], order: list[str], path: str) -> None:
    """Text part files that read in order as one Markdown table, head first."""
    spark = table.sparkSession
    head = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    rows = markdown_rows(table, columns).select(F.lit(len(head)).alias("_part"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], "line")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    first = spark.createDataFrame([(k, *[None] * len(order), line) for k, line in enumerate(head)], kinds)
    first.unionByName(rows).orderBy("_part", *[f"_o{k}" for k in range(len(order))]).select("line").write.text(path)


def compile_reports(spark: SparkSession, runs: str, out: str, prefix: str = "", binary: bool = False) -> dict[str, str]:
    """Reports of all summaries that match the pattern ``runs``; returns the paths of the tables and the Markdown."""
    detailed, means = run_tables(read_summaries(spark, runs), prefix, binary)
    keys = [c for c in ("dataset", "split", "ablation") if c in means.columns]
    ranked = lambda table: table.withColumns({"_d": reports.ordinal("dataset", reports.DATASET_ORDER), "_s": reports.ordinal("split", reports.SPLIT_ORDER)})
    order = ["_d", "_s", *keys]
    paths = {name: f"{out.rstrip('/')}/{name}" for name in ("detailed", "aggregate", "markdown")}
    reports.report_order(detailed).write.option("header", True).csv(paths["detailed"])
    ranked(means).orderBy(*order).drop("_d", "_s").write.option("header", True).csv(paths["aggregate"])
    write_markdown(ranked(means), means.columns, order, paths["markdown"])
    return paths


def newest_of_each(runs: DataFrame, names: DataFrame) -> DataFrame:
    """The newest summary of every wanted run name (name, task, dataset); a name without a run is left out."""
    return reports.keep_latest(runs).join(names.withColumnRenamed("name", "run_name"), "run_name")


def compare_tasks(spark: SparkSession, runs: str, names: DataFrame, out: str) -> dict[str, str]:
    """Binary and regression results of the named runs side by side, written as a table and as Markdown.

    ``names`` has one row (name, task, dataset) for each run to show.
    """
    found = newest_of_each(read_summaries(spark, runs), names)
    columns = ["dataset", "task", "run_name", *reports.BINARY_METRICS[:5], "rmse", "pearson", "spearman", "ci", "summary_path"]
    for metrics, task in ((reports.BINARY_METRICS, "regression"), (reports.REGRESSION_METRICS, "binary")):  # those of the other task are not shown
        found = found.withColumns({m: F.when(F.col("task") != task, F.col(m)) for m in metrics})
    table = found.select(*columns, reports.ordinal("dataset", reports.DATASET_ORDER).alias("_d"))
    order = ["_d", "dataset", "task", "run_name"]
    paths = {name: f"{out.rstrip('/')}/{name}" for name in ("comparison", "comparison_markdown")}
    table.orderBy(*order).drop("_d").write.option("header", True).csv(paths["comparison"])
    write_markdown(table, columns[:-1], order, paths["comparison_markdown"])
    return paths
