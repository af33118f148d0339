"""Queries over run records and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadic import reports
from dyadic.plans.inputs import IDENTITY, RUNS, num, r9, run_records, table
from dyadic.plans.registry import query
from dyadic.reports import chain

_LATEST = f"""{RUNS}, {IDENTITY}, latest as (select * exclude (rn) from (select *, row_number() over
 (partition by run_name order by summary_path desc) rn from named) where rn = 1)"""
_KEYS = ["dataset", "split", "ablation"]


def _latest(spark, folder):
    return reports.parse_regression_identity(reports.keep_latest(run_records(spark, folder)))


@query("runs_scan_prefix", f"with {RUNS} select run_name, summary_path, status from runs where starts_with(run_name, 'PAIR_EVAL_VIEW')")
def runs_scan_prefix(spark, folder):
    return reports.with_prefix(run_records(spark, folder), "PAIR_EVAL_VIEW").select("run_name", "summary_path", "status")


@query("run_identity_parse", f"with {RUNS}, {IDENTITY} select event_id, dataset, split, ablation, seed from named")
def run_identity_parse(spark, folder):
    return reports.parse_regression_identity(run_records(spark, folder)).select("event_id", *_KEYS, "seed")


@query("summary_flatten", """select event_id, try_cast(json_extract_string(props, '$.k') as double) k, round(value / 500, 9) ci,
 cast(null as double) absent from events""")
def summary_flatten(spark, folder):
    """Summaries as nested JSON texts, flattened by path; a path that is not there is NULL."""
    events = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    summary = F.to_json(F.struct(k.alias("k"), F.struct((F.col("value") / 500).alias("ci")).alias("metrics")))
    flat = reports.flatten_json(events.withColumn("summary", summary), "summary", {"k": "$.k", "ci": "$.metrics.ci", "absent": "$.metrics.none"})
    return flat.select("event_id", "k", r9("ci").alias("ci"), "absent")


@query("dedupe_latest", f"with {_LATEST} select run_name, summary_path, ci, rmse, status, event_id from latest")
def dedupe_latest(spark, folder):
    return reports.keep_latest(run_records(spark, folder))


@query("report_aggregate", f"""with {_LATEST} select dataset, split, ablation, count(*) n_runs, round(avg({num('ci')}), 9) ci_mean,
 round(avg({num('rmse')}), 9) rmse_mean from latest group by 1, 2, 3""")
def report_aggregate(spark, folder):
    found = reports.mean_by_group(_latest(spark, folder), _KEYS, ["ci", "rmse"])
    return found.select(*_KEYS, "n_runs", r9("ci_mean").alias("ci_mean"), r9("rmse_mean").alias("rmse_mean"))


@query("report_mean_std", f"""with {_LATEST} select dataset, split, count(*) n_runs, round(avg({num('ci')}), 9) ci_mean,
 round(stddev_samp({num('ci')}), 9) ci_std from latest group by 1, 2""")
def report_mean_std(spark, folder):
    found = reports.mean_and_std(_latest(spark, folder), ["dataset", "split"], ["ci"])
    return found.select("dataset", "split", "n_runs", r9("ci_mean").alias("ci_mean"), r9("ci_std").alias("ci_std"))


@query("report_best_per_split", f"""with {_LATEST}, g as (select dataset, split, round(avg({num('rmse')}), 9) rmse_mean from latest group by 1, 2)
 select split, dataset, rmse_mean from (select *, row_number() over (partition by split order by rmse_mean desc, dataset desc) rn from g) where rn = 1""")
def report_best_per_split(spark, folder):
    means = reports.mean_by_group(_latest(spark, folder), ["dataset", "split"], ["rmse"])
    return reports.best_per_split(means.withColumn("rmse_mean", r9("rmse_mean")), "rmse_mean")


_SHOWN = "coalesce(round(round({0}, 9)::decimal(18, 9), 4)::decimal(18, 4)::varchar, '-')"


@query("report_markdown", f"""with {_LATEST}, g as (select dataset, split, ablation, count(*) n, avg({num('ci')}) ci, avg({num('rmse')}) rmse from latest group by 1, 2, 3)
 select dataset, split, ablation, '| ' || concat_ws(' | ', dataset, split, ablation, n, {_SHOWN.format('ci')}, {_SHOWN.format('rmse')}) || ' |' as line from g""")
def report_markdown(spark, folder):
    """Rows of the aggregated report as Markdown."""
    means = reports.mean_by_group(_latest(spark, folder), _KEYS, ["ci", "rmse"])
    means = means.withColumns({c: r9(c) for c in ("ci_mean", "rmse_mean")})
    return chain.markdown_rows(means, [*_KEYS, "n_runs", "ci_mean", "rmse_mean"]).select(*_KEYS, "line")


@query("report_gate_rules", f"""with {_LATEST}, g as (select dataset, ablation branch, avg({num('rmse')}) m from latest
 where ablation in ('FULL', 'NO_CF') group by 1, 2), p as (select dataset, max(case when branch = 'FULL' then m end) c,
 max(case when branch = 'NO_CF' then m end) b from g group by 1)
 select count(*) n_datasets, count(*) filter (where c >= b) n_not_worse, count(*) filter (where c >= b) >= 2 passes from p""")
def report_gate_rules(spark, folder):
    runs = _latest(spark, folder).where(F.col("ablation").isin("FULL", "NO_CF"))
    means = reports.mean_by_group(runs, ["dataset", "ablation"], ["rmse"]).withColumnRenamed("ablation", "branch")
    return reports.non_inferiority(means, "FULL", "NO_CF", "rmse_mean")


@query("gate_status_rollup", f"""with {RUNS} select count(*) total, count(*) filter (where status = 'PASS') passed,
 count(*) filter (where status <> 'PASS') failed from runs""")
def gate_status_rollup(spark, folder):
    return reports.status_rollup(run_records(spark, folder))


@query("report_order", f"with {_LATEST} select dataset, split, ablation, seed, run_name from latest")
def report_order(spark, folder):
    return reports.report_order(_latest(spark, folder)).select(*_KEYS, "seed", "run_name")


@query("report_wide_union", f"""with {_LATEST} select run_name, 'binary' task, null::double ci, case when {num('rmse')} is null then '-'
 else printf('%.4f', {num('rmse')}) end shown from latest where status = 'PASS' union all
 select run_name, 'regression', {num('ci')}, null from latest where status <> 'PASS'""")
def report_wide_union(spark, folder):
    runs = _latest(spark, folder).withColumn("rmse", F.col("rmse").try_cast("double"))
    left = runs.where("status = 'PASS'").select("run_name", reports.show_metric("rmse").alias("shown"))
    right = runs.where("status <> 'PASS'").select("run_name", F.nullif(F.col("ci").try_cast("double"), F.lit(float("nan"))).alias("ci"))
    return reports.wide_union(left, right)


@query("experiment_matrix", """select distinct upper(event_type) dataset, split, ablation, cast(seed as int) seed from events,
 (select unnest(['random', 'cold_drug', 'cold_target']) split), (select unnest(['full', 'no_causal', 'no_irm', 'no_cf', 'no_mas']) ablation),
 (select unnest([10, 34, 42]) seed)""")
def experiment_matrix(spark, folder):
    datasets = table(spark, folder, "events").select(F.upper("event_type").alias("dataset"))
    return reports.experiment_matrix(datasets, ["random", "cold_drug", "cold_target"], [10, 34, 42], list(reports.ABLATIONS))


@query("runs_missing_registry", f"""with {RUNS} select distinct run_name from runs where run_name not in
 (select run_name from runs where status = 'PASS' and {num('ci')} > 0.5)""")
def runs_missing_registry(spark, folder):
    runs = run_records(spark, folder)
    registered = runs.where((F.col("status") == "PASS") & (F.nullif(F.col("ci").try_cast("double"), F.lit(float("nan"))) > 0.5))
    return runs.select("run_name").distinct().join(registered.select("run_name").distinct(), "run_name", "left_anti")
