"""Checks around runs: source precheck, output validation, the gate that chains them, and its reports."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from dyadic.runs import artifacts
from dyadic.runs.runner import BAD_CONFIG, NO_CONFIG, OK, STRICT_PLACEHOLDER, read_config
from dyadic.sources import tables

REMEDIES = {
    NO_CONFIG: "create the configuration file or correct its path",
    BAD_CONFIG: "fix the listed configuration errors",
    STRICT_PLACEHOLDER: "provide the source files or correct their columns",
}


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def write_report(path: str | Path, payload: dict) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(payload, indent=2), encoding="utf-8")
    return path


def inspect_source(spark: SparkSession, name: str, path: str) -> dict:
    """Layout, columns and counts of a source; ``status`` is ok or error with a reason."""
    name = name.upper()
    affinity = name.startswith("BINDINGDB")
    layout = ("csv", path) if affinity and tables.path_exists(spark, path) else None if affinity else tables.resolve_layout(spark, path, name)
    if layout is None:
        return {"status": "error", "reason": f"no source files at {path}"}
    try:
        if layout[0] == "triplet":
            data = tables.read_triplet(spark, path, name)
            counts = {"n_left": data.left.count(), "n_right": data.right.count(), "num_data_rows": data.pairs.count()}
            return {"status": "ok", "layout": "triplet", **counts}
        rows = tables.read_strings(spark, layout[1])
        wanted = [tables.LEFT_ID, tables.RIGHT_ID, tables.VALUE]
        if not affinity:
            wanted += [tables.LEFT_TEXT, tables.RIGHT_TEXT]
        columns, lacking = (tables.resolve_columns(rows.columns, wanted) if affinity
                            else ({c: c for c in wanted}, tables.missing_columns(rows, wanted)))
        report = {"layout": "csv", "available_columns": [c for c in rows.columns if c not in tables.SEQ],
                  "resolved_columns": columns, "missing_columns": lacking}
        if lacking:
            return {"status": "error", "reason": f"missing columns {lacking}", **report}
        left, right = columns[tables.LEFT_ID], columns[tables.RIGHT_ID]
        filled = [tables.present(f"`{c}`") for c in report["available_columns"]]
        any_filled = filled[0]
        for test in filled[1:]:
            any_filled = any_filled | test
        counts = rows.where(any_filled).agg(
            F.count("*").alias("num_data_rows"), F.countDistinct(F.col(f"`{left}`")).alias("n_left"),
            F.countDistinct(F.col(f"`{right}`")).alias("n_right"),
        ).first().asDict()
        if not counts["num_data_rows"]:
            return {"status": "error", "reason": "no data rows", **report, **counts}
        return {"status": "ok", **report, **counts}
    except tables.SourceError as error:
        return {"status": "error", "reason": str(error), "layout": layout[0]}


def check_data(spark: SparkSession, path: str, report_path: str | None = None) -> int:
    """0 usable, 1 no configuration, 2 invalid configuration, 3 unusable source."""
    code, config = read_config(path)
    payload: dict = {"config": str(path), "checked_at": _now()}
    if code == OK:
        dataset = config.get("dataset")
        if not dataset:
            code, payload["reason"] = BAD_CONFIG, "no dataset section"
        else:
            payload["source"] = inspect_source(spark, dataset["name"], str(dataset["path"]))
            if payload["source"]["status"] != "ok":
                code = STRICT_PLACEHOLDER
    payload.update(exit_code=code, status="ok" if code == OK else "error")
    if code in REMEDIES:
        payload["next_action"] = REMEDIES[code]
    if report_path:
        write_report(report_path, payload)
    return code


def check_all(spark: SparkSession, paths: list[str]) -> int:
    codes = {p: check_data(spark, p) for p in paths}
    for path, code in codes.items():
        print(f"{'PASS' if code == OK else 'FAIL'} {path}" + ("" if code == OK else f": {REMEDIES[code]}"))
    return int(any(codes.values()))


def output_problems(spark: SparkSession, config: dict) -> list[str]:
    """What the newest run of a configuration lacks."""
    base, name = str(config["output"]["base_dir"]), config["name"]
    folder = artifacts.latest_run(spark, base, name)
    if folder is None:
        return ["no run folder"]
    wanted = [artifacts.SUMMARY, artifacts.SNAPSHOT, *([artifacts.PREDICTIONS] if config.get("dataset") else [])]
    lacking = [f for f in wanted if not artifacts.exists(spark, f"{folder}/{f}")]
    problems = [f"missing {f}" for f in lacking]
    if artifacts.SUMMARY not in lacking and json.loads(artifacts.read_text(spark, f"{folder}/{artifacts.SUMMARY}")).get("status") != "completed":
        problems.append("status is not completed")
    own = F.col("summary_path").endswith(f"{folder.rsplit('/', 1)[-1]}/{artifacts.SUMMARY}")
    if artifacts.registry(spark, base).where(own).isEmpty():
        problems.append("no registry row")
    return problems


def validate_outputs(spark: SparkSession, paths: list[str], report_path: str | None = None) -> int:
    """Every configuration has a newest run with its artifacts, a completed status and a registry row."""
    results = []
    for path in paths:
        code, config = read_config(path)
        problems = [f"configuration error {code}"] if code != OK else output_problems(spark, config)
        results.append({"config": str(path), "status": "FAIL" if problems else "PASS", "problems": problems})
    failed = sum(r["status"] == "FAIL" for r in results)
    payload = {"checked_at": _now(), "overall_status": "FAIL" if failed else "PASS", "failed": failed,
               "passed": len(results) - failed, "results": results}
    if report_path:
        write_report(report_path, payload)
    return int(failed > 0)


def gate(steps: list[tuple[str, Callable[[], int]]], report_path: str | None = None) -> dict:
    """Run steps in order; after a failure the rest is skipped."""
    done, broken = [], False
    for name, step in steps:
        code = None if broken else step()
        status = "SKIPPED" if broken else "PASS" if code == 0 else "FAIL"
        broken = broken or code != 0
        done.append({"name": name, "return_code": code, "status": status})
    payload = {"finished_at": _now(), "overall_status": "FAIL" if broken else "PASS", "steps": done,
               "failed": sum(s["status"] == "FAIL" for s in done)}
    if report_path:
        write_report(report_path, payload)
    return payload


def gate_markdown(report: dict) -> str:
    lines = ["# Gate summary", "", f"Status: {report['overall_status']}", "", "| step | status | code |", "| --- | --- | --- |"]
    lines += [f"| {s['name']} | {s['status']} | {'-' if s['return_code'] is None else s['return_code']} |" for s in report["steps"]]
    return "\n".join(lines) + "\n"
