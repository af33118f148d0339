"""What a run leaves behind, written through Spark's file systems: driver and executors see the same files.

A run owns one folder ``<base>/runs/<name>_<stamp>``. Documents are small texts, results are Parquet tables. The registry
is a Parquet table with one folder for each run, named by a digest of the run's summary path: two runs that end at once
write different folders, and a run that is registered again replaces its own row only.
"""

from __future__ import annotations

import hashlib
import json
from datetime import datetime

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.reports import pivot_predictions

# Names of a run's documents and tables, and the columns of the registry.
SUMMARY, SNAPSHOT, PREDICTIONS, SCORED_PAIRS, TOP_SCORES, FACTORS = (
    "summary.json", "config_snapshot.yaml", "predictions", "scored_pairs", "top_scores", "checkpoints/embeddings")
REGISTRY_COLUMNS = ["run_name", "protocol", "status", "summary_path", "config_snapshot_path", "created_at"]
REGISTRY = "registry"
WIDE_COLUMNS = 2_000


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object of a path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = file_system(spark, path)
    return files.exists(place)


def write_text(spark: SparkSession, path: str, text: str) -> str:
    files, place = file_system(spark, path)
    stream = files.create(place, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    return path


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def open_run(spark: SparkSession, base: str, name: str) -> str:
    """A new folder of the run; runs that start within one second get a number behind the stamp."""
    stamp = f"{base.rstrip('/')}/runs/{name}_{datetime.now():%Y%m%d_%H%M%S}"
    number = 0
    while exists(spark, folder := stamp + (f"_{number}" if number else "")):
        number += 1
    files, place = file_system(spark, folder)
    files.mkdirs(place)
    return folder


def latest_run(spark: SparkSession, base: str, name: str) -> str | None:
    """Newest run folder of a name; stamps sort as text."""
    files, pattern = file_system(spark, f"{base.rstrip('/')}/runs/{name}_*")
    found = sorted(s.getPath().toUri().getPath() if s.getPath().toUri().getScheme() == "file" else s.getPath().toString()
                   for s in files.globStatus(pattern) or [] if s.isDirectory())
    return found[-1] if found else None


def write_documents(spark: SparkSession, folder: str, summary: dict, config: dict) -> dict:
    """Summary and configuration of a run; returns their paths."""
    return {"summary_path": write_text(spark, f"{folder}/{SUMMARY}", json.dumps(summary, indent=2)),
            "config_snapshot_path": write_text(spark, f"{folder}/{SNAPSHOT}", yaml.safe_dump(config, sort_keys=False))}


def write_table(folder: str, name: str, rows: DataFrame) -> str:
    rows.write.parquet(f"{folder}/{name}")
    return f"{folder}/{name}"


def write_factors(folder: str, factors: DataFrame | None) -> str:
    """Trained vectors ``(side, key, vec)``."""
    if factors is None:
        raise RuntimeError("nothing to save: the model has not been fitted")
    return write_table(folder, FACTORS, factors.select("side", "key", "vec"))


def write_wide_predictions(folder: str, scores: DataFrame, max_columns: int = WIDE_COLUMNS) -> str:
    """One CSV row per left entity, for result sets narrow enough to be a sheet."""
    path = f"{folder}/predictions_wide"
    pivot_predictions(scores, max_columns).withColumnRenamed("a", "drug_id").write.option("header", True).csv(path)
    return path


def register(spark: SparkSession, base: str, run: dict) -> None:
    """Put a run's row into the registry; doing it twice leaves one row."""
    row = [tuple(str(run.get(c, "")) for c in REGISTRY_COLUMNS)]
    own = hashlib.sha256(str(run["summary_path"]).encode()).hexdigest()[:24]
    spark.createDataFrame(row, ", ".join(f"{c} string" for c in REGISTRY_COLUMNS)).coalesce(1).write.mode("overwrite").parquet(
        f"{base.rstrip('/')}/{REGISTRY}/run={own}")


def registry(spark: SparkSession, base: str) -> DataFrame:
    """All registered runs; an empty table before the first."""
    path = f"{base.rstrip('/')}/{REGISTRY}"
    schema = ", ".join(f"{c} string" for c in REGISTRY_COLUMNS)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*REGISTRY_COLUMNS)


def never_completed(spark: SparkSession, base: str, names: list[str]) -> DataFrame:
    """Those of the given run names that no completed run in the registry has."""
    wanted = spark.createDataFrame([(n,) for n in names], "run_name string").distinct()
    return wanted.join(registry(spark, base).where(F.col("status") == "completed"), "run_name", "left_anti")
