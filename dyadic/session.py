"""Session helpers: a local builder for tests and the lineage cut used by iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "dyadic") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):  # one machine: its own folder will do
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session or its context names; without one nothing can be written for all executors."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = given.get() if given.isDefined() else None
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and continue from there.

    For results that are read several times or feed a loop. The table outlives lost executors, its plan is
    a plain scan however long the history was, and its size is known to the optimizer, which then picks
    broadcast or shuffle joins by measured size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/dyadic-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._stored_at = path
    return kept


def forget(df: DataFrame) -> None:
    """Delete the files of a table that :func:`cut_lineage` wrote, once a loop's next table is written and nothing reads it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread_scan(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan with fewer partitions than cores over all of them before heavy per-row work.

    A large input has plenty of splits and is returned unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
