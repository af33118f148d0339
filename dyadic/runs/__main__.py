"""``python -m dyadic.runs --config X [--binary] (--dry-run | --check-data | --run-once)``

``python -m dyadic.runs --report <runs folder> --out <folder> [--prefix P] [--binary]`` writes the reports of all runs.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from dyadic.reports.chain import compile_reports
from dyadic.runs.checks import check_data
from dyadic.runs.runner import dry_run, run_all


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--config", action="append", default=[])
    for name in ("report", "out", "prefix"):
        parser.add_argument(f"--{name}", default="")
    for flag in ("binary", "dry-run", "check-data", "run-once"):
        parser.add_argument(f"--{flag}", action="store_true")
    args = parser.parse_args(argv)
    if args.report:
        paths = compile_reports(SparkSession.builder.getOrCreate(), f"{args.report}/*/summary.json", args.out or f"{args.report}/reports", args.prefix, args.binary)
        print("\n".join(f"[OK] {name}: {path}" for name, path in paths.items()))
        return 0
    if not args.config:
        parser.error("--config or --report is needed")
    if args.check_data:
        spark = SparkSession.builder.getOrCreate()
        return max(check_data(spark, path) for path in args.config)
    if args.dry_run:
        return max(dry_run(path, args.binary) for path in args.config)
    if args.run_once:
        return run_all(SparkSession.builder.getOrCreate(), args.config, args.binary)
    print("nothing to do: choose --check-data, --dry-run or --run-once")
    return 0


if __name__ == "__main__":
    sys.exit(main())
