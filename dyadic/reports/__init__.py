"""Tables over many runs: identity parsing, flattening, dedup, aggregation, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadic.functions.numeric import coerce_number

UNKNOWN = "UNKNOWN"
# Report orders of data sets and split strategies; anything else sorts behind them.
DATASET_ORDER = ["DAVIS", "KIBA", "BINDINGDB"]
SPLIT_ORDER = ["RANDOM", "COLD_DRUG", "COLD_TARGET"]
LAST_ORDER = 99
ABLATIONS = {"full": None, "no_causal": "lambda_xview", "no_irm": "lambda_irm", "no_cf": "lambda_cf", "no_mas": "lambda_mas"}

REGRESSION_METRICS = ["ci", "rmse", "pearson", "spearman"]
BINARY_METRICS = ["auroc", "auprc", "f1", "accuracy", "sensitivity", "specificity", "precision"]


def _tokens(run_name: Column) -> Column:
    return F.split(run_name, "_")


def _seed(tokens: Column) -> Column:
    return F.regexp_replace(F.element_at(tokens, -1), "^S+", "")


def parse_regression_identity(runs: DataFrame, name: str = "run_name") -> DataFrame:
    """dataset, split, ablation, seed from ``X_EVAL_<dataset>_<split>_<ablation>_S<seed>``.

    A split that starts with COLD takes two tokens when at least three identity tokens are present.
    """
    tokens = _tokens(F.col(name))
    n = F.size(tokens)
    middle = F.slice(tokens, 4, F.greatest(n - 4, F.lit(0)))
    cold = (F.size(middle) >= 3) & (F.get(middle, F.lit(0)) == "COLD")
    taken = F.when(cold, 2).otherwise(1)
    rest = F.slice(middle, taken + 1, F.greatest(F.size(middle) - taken, F.lit(0)))
    short = n < 6
    return runs.select(
        "*",
        F.when(short, UNKNOWN).otherwise(F.get(tokens, F.lit(2))).alias("dataset"),
        F.when(short, UNKNOWN).otherwise(F.array_join(F.slice(middle, F.lit(1), taken), "_")).alias("split"),
        F.when(short | (F.size(rest) == 0), UNKNOWN).otherwise(F.array_join(rest, "_")).alias("ablation"),
        F.when(short, UNKNOWN).otherwise(_seed(tokens)).alias("seed"),
    )


def parse_binary_identity(runs: DataFrame, name: str = "run_name") -> DataFrame:
    """dataset, split, seed from ``X_BINARY_EVAL_<dataset>_<split>_S<seed>``."""
    tokens = _tokens(F.col(name))
    n = F.size(tokens)
    middle = F.slice(tokens, 5, F.greatest(n - 5, F.lit(0)))
    short = n < 6
    return runs.select(
        "*",
        F.when(short, UNKNOWN).otherwise(F.get(tokens, F.lit(3))).alias("dataset"),
        F.when(short, UNKNOWN).otherwise(F.array_join(middle, "_")).alias("split"),
        F.when(short, UNKNOWN).otherwise(_seed(tokens)).alias("seed"),
    )


def with_prefix(runs: DataFrame, prefix: str, name: str = "run_name") -> DataFrame:
    return runs.where(F.col(name).startswith(prefix))


def flatten_json(frame: DataFrame, column: str, paths: dict[str, str]) -> DataFrame:
    """Numbers at JSON paths; a missing level gives NULL."""
    return frame.select("*", *[coerce_number(F.get_json_object(column, p)).alias(out) for out, p in paths.items()])


def keep_latest(runs: DataFrame, key: str = "run_name", order: str = "summary_path") -> DataFrame:
    """The row with the largest ``order`` string per key, found by partial aggregation."""
    best = runs.groupBy(key).agg(F.max_by(F.struct(*runs.columns), F.col(order)).alias("_row"))
    return best.select("_row.*")


def mean_by_group(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Group size and the mean of each metric over the rows where it is a number."""
    return runs.groupBy(*keys).agg(
        F.count("*").alias("n_runs"), *[F.avg(coerce_number(m)).alias(f"{m}_mean") for m in metrics]
    )


def mean_and_std(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample standard deviation over seeds."""
    parts = []
    for m in metrics:
        parts += [F.avg(coerce_number(m)).alias(f"{m}_mean"), F.stddev_samp(coerce_number(m)).alias(f"{m}_std")]
    return runs.groupBy(*keys).agg(F.count("*").alias("n_runs"), *parts)


def best_per_split(table: DataFrame, metric: str) -> DataFrame:
    """Data set with the largest metric per split (ties: the later name)."""
    best = table.groupBy("split").agg(F.max(F.struct(metric, "dataset")).alias("_best"))
    return best.select("split", F.col("_best.dataset").alias("dataset"), F.col(f"_best.{metric}").alias(metric))


def non_inferiority(table: DataFrame, challenger: str, baseline: str, metric: str, needed: int = 2) -> DataFrame:
    """One row: in how many data sets the challenger branch is at least as good, and whether that suffices."""
    per_set = table.groupBy("dataset").agg(
        F.max(F.when(F.col("branch") == challenger, F.col(metric))).alias("_c"),
        F.max(F.when(F.col("branch") == baseline, F.col(metric))).alias("_b"),
    )
    return per_set.agg(
        F.count("*").alias("n_datasets"), F.count_if(F.col("_c") >= F.col("_b")).alias("n_not_worse")
    ).withColumn("passes", F.col("n_not_worse") >= needed)


def status_rollup(steps: DataFrame, status: str = "status", passed: str = "PASS") -> DataFrame:
    return steps.agg(
        F.count("*").alias("total"), F.count_if(F.col(status) == passed).alias("passed"),
        F.count_if(F.col(status) != passed).alias("failed"),
    )


def ordinal(column: str, names: list[str]) -> Column:
    out = F.lit(LAST_ORDER)
    for position, name in reversed(list(enumerate(names))):
        out = F.when(F.col(column) == name, position).otherwise(out)
    return out


def report_order(table: DataFrame) -> DataFrame:
    """Rows in report order: data set, split, numeric seed (0 where it does not parse)."""
    seed = F.coalesce(F.col("seed").try_cast("int"), F.lit(0))
    return table.orderBy(ordinal("dataset", DATASET_ORDER), ordinal("split", SPLIT_ORDER), "dataset", "split", seed)


def wide_union(binary: DataFrame, regression: DataFrame) -> DataFrame:
    """Both kinds of result rows under all columns, absent metrics NULL."""
    return binary.withColumn("task", F.lit("binary")).unionByName(
        regression.withColumn("task", F.lit("regression")), allowMissingColumns=True
    )


def show_metric(column: str) -> Column:
    """Four decimals, a dash for NULL."""
    return F.when(F.col(column).isNull(), F.lit("-")).otherwise(F.format_string("%.4f", F.col(column)))


def experiment_matrix(datasets: DataFrame, splits: list[str], seeds: list[int],
                      ablations: list[str] | None = None) -> DataFrame:
    """One row per setting. The factor lists are short constants, expanded in place."""
    out = datasets.select("dataset").distinct()
    out = out.withColumn("split", F.explode(F.array(*[F.lit(s) for s in splits])))
    if ablations is not None:
        out = out.withColumn("ablation", F.explode(F.array(*[F.lit(a) for a in ablations])))
    return out.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))


def newest(files: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Value with the largest order per key, e.g. the newest artifact of each run."""
    return files.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def most_recent(files: DataFrame, order: str, tie: str, n: int) -> DataFrame:
    return files.orderBy(F.col(order).desc(), F.col(tie).desc()).limit(n)


def pivot_predictions(scores: DataFrame, max_columns: int = 10_000) -> DataFrame:
    """Wide export: a row per left entity, a column per right entity, values with six decimals.

    The column count is checked first; wider results stay long.
    """
    names = [r.b for r in scores.select("b").distinct().limit(max_columns + 1).collect()]
    if len(names) > max_columns:
        raise ValueError(f"more than {max_columns} columns; write the long form instead")
    return scores.groupBy("a").pivot("b", sorted(names)).agg(F.first(F.format_string("%.6f", "y_hat")))


def to_markdown(table: DataFrame, columns: list[str], max_rows: int = 10_000) -> str:
    """Markdown of an aggregated report; more than ``max_rows`` rows are refused, not cut."""
    rows = table.select(*columns).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows; write the table instead")

    def cell(value) -> str:
        return "-" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)

    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in row) + " |" for row in rows]) + "\n"
