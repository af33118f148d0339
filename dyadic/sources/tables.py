"""Readers of pair data: flat CSV (plain, aliased, binary), text triplets, embeddings, run artifacts.

Every reader keeps strings as strings and converts by name; bad values become NULL and are dropped, never an error.
A source that is missing or malformed yields the small placeholder set, flagged in ``meta``.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadic.functions.numeric import affinity_label, coerce_number, is_finite
from dyadic.operators.pairs import PairData, entity_index, first_content, last_write
from dyadic.operators.skew import lookup

# Column names of the flat layouts, their accepted aliases, and the text triplet's file names.
LEFT_ID, LEFT_TEXT, RIGHT_ID, RIGHT_TEXT, VALUE, LABEL = "Drug_ID", "Drug", "Target_ID", "Target", "Y", "Label"
ALIASES = {
    LEFT_TEXT: ["Drug", "Drug (SMILES)"],
    RIGHT_TEXT: ["Target", "Target (sequence)"],
    LEFT_ID: ["Drug_ID", "Drug", "Drug (SMILES)"],
    RIGHT_ID: ["Target_ID", "Target", "Target (sequence)"],
    VALUE: ["Y", "Label"],
}
TRIPLET = ("drug_smiles.txt", "target_sequences.txt", "Y.txt")
PLACEHOLDER_LEFT = ["drug_0", "drug_1"]
PLACEHOLDER_RIGHT = ["target_0", "target_1"]
PLACEHOLDER_BINARY = [[1.0, 0.0], [0.0, 1.0]]
PLACEHOLDER_CONTINUOUS = [[0.8, 0.2], [0.3, 0.9]]

SEQ = ["_file", "_block", "_line"]
NPZ_ROWS = 1024  # vectors of an archive in one batch


class SourceError(Exception):
    """The source cannot be read as pair data."""


def quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether some line has an odd number of quotes, so that a quoted field runs over several lines.

    Files without such fields are split among tasks; a file with one has to be read by one task.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """CSV with all columns as strings, plus the row's place in the source (file, block, position)."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", quoted_breaks(spark, path)).csv(path)
    return raw.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    ).withColumn("_line", F.monotonically_increasing_id())


def missing_columns(frame: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(frame.columns))


def resolve_columns(columns: list[str], needed: list[str]) -> tuple[dict[str, str], list[str]]:
    """First alias present for each needed column, and the needed columns without any."""
    found = {n: next((o for o in ALIASES.get(n, [n]) if o in columns), None) for n in needed}
    return {n: o for n, o in found.items() if o}, [n for n, o in found.items() if not o]


def present(column: str) -> Column:
    return F.col(column).isNotNull() & (F.trim(F.col(column)) != "")


def flat_pairs(rows: DataFrame, value: Column, order: list[str], left: str = "a_id", right: str = "b_id",
               required: tuple[str, ...] = ("a_id", "a_text", "b_id", "b_text"), keep: Column | None = None) -> PairData:
    """Clean flat rows ``a_id, a_text, b_id, b_text`` into pairs and entities.

    Rows with an empty required field or a value that is not a finite number are dropped. Repeated pairs keep
    their last value, repeated entities their first text. ``left`` and ``right`` name the identifying columns.
    """
    clean = rows.withColumn("y", value).where(is_finite("y"))
    for column in required:
        clean = clean.where(present(column))
    if keep is not None:
        clean = clean.where(keep)
    clean = clean.withColumn("a", F.col(left)).withColumn("b", F.col(right))
    return PairData(
        last_write(clean, ["a", "b"], "y", order),
        first_content(clean, "a", "a_text", order),
        first_content(clean, "b", "b_text", order),
    )


def clean_regression(rows: DataFrame, order: list[str]) -> PairData:
    return flat_pairs(rows, coerce_number("y_text"), order)


def clean_binary(rows: DataFrame, order: list[str]) -> PairData:
    """Only labels that are exactly 0 or 1 survive; unknown pairs are absent."""
    return flat_pairs(rows, coerce_number("y_text"), order, keep=F.col("y").isin(0.0, 1.0))


def clean_affinity(rows: DataFrame, order: list[str], threshold: float = 7.6,
                   left: str = "a_text", right: str = "b_text") -> PairData:
    """Affinities in nM turned into labels; see :func:`dyadic.functions.numeric.affinity_label`.

    Texts are optional here and identify an entity by default, so equal texts under several ids are one entity.
    """
    texts = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("a_text", "b_text")})
    data = flat_pairs(texts, coerce_number("y_text"), order, left, right, ("a_id", "b_id"))
    return data.with_pairs(data.pairs.withColumn("y", affinity_label("y", threshold).cast("double")))


def _flat(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns of the flat layout under fixed names; an absent text column repeats the id."""
    pick = lambda name, other: F.col(f"`{columns.get(name, columns[other])}`")
    return frame.select(
        pick(LEFT_ID, LEFT_ID).alias("a_id"), pick(LEFT_TEXT, LEFT_ID).alias("a_text"),
        pick(RIGHT_ID, RIGHT_ID).alias("b_id"), pick(RIGHT_TEXT, RIGHT_ID).alias("b_text"),
        F.col(columns[VALUE]).alias("y_text"), *SEQ,
    )


def _tag(data: PairData, source: str, placeholder: bool = False) -> PairData:
    data.meta.update(source=source, is_placeholder=placeholder)
    return data


def placeholder(spark: SparkSession, source: str, values: list[list[float]]) -> PairData:
    """The fixed 2 x 2 set that stands in for an unusable source."""
    cells = [
        (a, b, values[i][j]) for i, a in enumerate(PLACEHOLDER_LEFT) for j, b in enumerate(PLACEHOLDER_RIGHT)
    ]
    pairs = spark.createDataFrame(cells, "a string, b string, y double")
    left = spark.createDataFrame([(k, k) for k in PLACEHOLDER_LEFT], "key string, content string")
    right = spark.createDataFrame([(k, k) for k in PLACEHOLDER_RIGHT], "key string, content string")
    return _tag(PairData(pairs, left, right), source, True)


def _required(frame: DataFrame, columns: list[str]) -> None:
    lacking = missing_columns(frame, columns)
    if lacking:
        raise SourceError(f"missing columns {lacking}")


def read_affinity(spark: SparkSession, path: str, source: str, threshold: float = 7.6) -> PairData:
    """Aliased CSV whose text columns are optional; where a side has texts, they identify its entities."""
    frame = read_strings(spark, path)
    columns, lacking = resolve_columns(frame.columns, list(ALIASES))
    if set(lacking) - {LEFT_TEXT, RIGHT_TEXT}:
        raise SourceError(f"missing columns {lacking}")
    left = "a_text" if LEFT_TEXT in columns else "a_id"
    right = "b_text" if RIGHT_TEXT in columns else "b_id"
    return _tag(clean_affinity(_flat(frame, columns), SEQ, threshold, left, right), source)


def read_regression(spark: SparkSession, path: str, source: str) -> PairData:
    frame = read_strings(spark, path)
    names = [LEFT_ID, LEFT_TEXT, RIGHT_ID, RIGHT_TEXT, VALUE]
    _required(frame, names)
    return _tag(clean_regression(_flat(frame, {n: n for n in names}), SEQ), source)


def read_binary(spark: SparkSession, path: str, source: str) -> PairData:
    frame = read_strings(spark, path)
    names = [LEFT_ID, LEFT_TEXT, RIGHT_ID, RIGHT_TEXT, LABEL]
    _required(frame, names)
    columns = {n: n for n in names[:4]} | {VALUE: LABEL}
    return _tag(clean_binary(_flat(frame, columns), SEQ), source)


def indexed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(idx, value)``: non-blank lines with their 0-based position.

    Positions inside a partition come from the row id; only the line count of each partition reaches the driver.
    """
    lines = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id()).where(F.trim("value") != "")
    placed = lines.withColumn("_part", F.shiftright("_id", 33))
    sizes = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())
    offsets, seen = {}, 0
    for part, size in sizes:
        offsets[part], seen = seen, seen + size
    if not offsets:
        return placed.select(F.lit(0).cast("bigint").alias("idx"), "value").where(F.lit(False))
    inside = F.row_number().over(W.partitionBy("_part").orderBy("_id")) - 1
    table = spark.createDataFrame(list(offsets.items()), "_part bigint, _offset bigint")
    return placed.join(F.broadcast(table), "_part").select((F.col("_offset") + inside).alias("idx"), F.trim("value").alias("value"))


def read_triplet(spark: SparkSession, folder: str, source: str) -> PairData:
    """Two entity files and a whitespace matrix, every cell known."""
    left, right, matrix = (indexed_lines(spark, os.path.join(folder, name)) for name in TRIPLET)
    n_left, n_right = left.count(), right.count()
    cells = matrix.select(F.col("idx").alias("_row"), F.posexplode(F.split("value", r"\s+")).alias("_col", "y_text"))
    shape = matrix.agg(F.count("*").alias("rows"), F.max(F.size(F.split("value", r"\s+"))).alias("width"),
                       F.sum(F.size(F.split("value", r"\s+"))).alias("cells")).first()
    whole = (shape.rows, shape.width) == (n_left, n_right) or 1 in (n_left, n_right) and 1 in (shape.rows, shape.width)
    if not n_left or not n_right or not whole or shape.cells != n_left * n_right:
        raise SourceError(f"matrix of {shape.rows} x {shape.width} does not fit {n_left} x {n_right} entities")
    at = F.col("_row") * F.lit(shape.width) + F.col("_col")
    placed = cells.select(
        F.floor(at / F.lit(n_right)).cast("bigint").alias("i"), (at % F.lit(n_right)).alias("j"), coerce_number("y_text").alias("y")
    )
    # Texts may repeat, so the line number is the key.
    keyed = placed.select(F.col("i").cast("string").alias("a"), F.col("j").cast("string").alias("b"), "y")
    entities = [s.select(F.col("idx").cast("string").alias("key"), F.col("value").alias("content")) for s in (left, right)]
    data = _tag(PairData(keyed.where(F.col("y").isNotNull()), *entities), source)
    data.meta["all_cells_listed"] = True  # what is missing is unknown, not zero
    return data


def _status(spark: SparkSession, path: str) -> list:
    """Hadoop's file states of a path or glob in any store that Spark reads; empty if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return list(found) if found is not None else []


def path_exists(spark: SparkSession, path: str) -> bool:
    return bool(path) and bool(_status(spark, path))


def resolve_layout(spark: SparkSession, path: str, source: str) -> tuple[str, str] | None:
    """('csv', path) or ('triplet', folder): a file or glob of files, then <source>.csv in the folder, then the triplet,
    then a folder of CSV parts."""
    found = _status(spark, path) if path else []
    if not found:
        return None
    if not found[0].isDirectory():
        return "csv", path
    for name in (f"{source.lower()}.csv", f"{source.upper()}.csv"):
        if path_exists(spark, os.path.join(path, name)):
            return "csv", os.path.join(path, name)
    if all(path_exists(spark, os.path.join(path, name)) for name in TRIPLET):
        return "triplet", path
    return ("csv", path) if path_exists(spark, os.path.join(path, "*.csv*")) else None


def _matrix_source(spark: SparkSession, path: str, source: str) -> PairData:
    layout = resolve_layout(spark, path, source)
    if layout is None:
        raise SourceError(f"nothing readable at {path}")
    return read_regression(spark, layout[1], source) if layout[0] == "csv" else read_triplet(spark, path, source)


def _affinity_source(spark: SparkSession, path: str, source: str) -> PairData:
    if not path_exists(spark, path):
        raise SourceError(f"nothing at {path}")
    return read_affinity(spark, path, source)


def _binary_source(spark: SparkSession, path: str, source: str) -> PairData:
    if not path_exists(spark, path):
        raise SourceError(f"nothing at {path}")
    return read_binary(spark, path, source)


# Data set names of run configurations, with their reader and placeholder.
SOURCES: dict[str, tuple[Callable, list]] = {
    "BINDINGDB": (_affinity_source, PLACEHOLDER_BINARY),
    "BINDINGDB_KD": (_affinity_source, PLACEHOLDER_BINARY),
    "DAVIS": (_matrix_source, PLACEHOLDER_CONTINUOUS),
    "KIBA": (_matrix_source, PLACEHOLDER_CONTINUOUS),
}


def load_pairs(spark: SparkSession, name: str, path: str, binary: bool = False) -> PairData:
    """Pair data of a named source; unknown names raise, unusable sources give the placeholder."""
    key = str(name).strip().upper()
    if key not in SOURCES:
        raise ValueError(f"unknown data set {name!r}; choose one of {', '.join(SOURCES)}")
    reader, values = SOURCES[key]
    reader, values = (_binary_source, PLACEHOLDER_BINARY) if binary else (reader, values)
    try:
        return reader(spark, str(path), key)
    except SourceError:
        return placeholder(spark, key, values)


def indexed_entities(entities: DataFrame) -> DataFrame:
    """Entities with their position in string order of the key."""
    return entities.join(entity_index(entities), "key")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Keyed vectors (key, embedding): a Parquet table, or numpy archives with the arrays ``keys`` and ``embeddings``.

    An archive is unpacked by the task that reads it. Vectors are found by key, so one without keys is an error.
    """
    if not path.endswith(".npz"):
        return spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                archive = np.load(BytesIO(content.as_py()), allow_pickle=False)
                if not {"keys", "embeddings"} <= set(archive.files):
                    raise SourceError(f"{path} needs the arrays keys and embeddings")
                keys, vectors = archive["keys"].astype(str), archive["embeddings"].astype(np.float64)
                if len(keys) != len(vectors):
                    raise SourceError(f"{path} has {len(keys)} keys for {len(vectors)} vectors")
                for at in range(0, len(keys), NPZ_ROWS):
                    part = vectors[at: at + NPZ_ROWS]
                    offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[at: at + NPZ_ROWS].tolist(), pa.string()), pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))], ["key", "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "key string, embedding array<double>")


def stored_vectors(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Vectors at a path; a path without files is reported and gives none, and the entities are hashed."""
    if not path:
        return None
    if not path_exists(spark, path):
        print(f"[WARN] no vectors at {path}; entities are hashed")
        return None
    return read_embeddings(spark, path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (a, b) cells to score, from Parquet with columns a and b or from CSV with the id columns of the flat layout."""
    if path.endswith(".csv"):
        rows = spark.read.option("header", True).csv(path).select(F.col(LEFT_ID).alias("a"), F.col(RIGHT_ID).alias("b"))
    else:
        rows = spark.read.parquet(path).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    return rows.dropna().distinct()


def read_summaries(spark: SparkSession, pattern: str) -> DataFrame:
    """Run summaries, one JSON document per file; unreadable files are skipped."""
    schema = (
        "run_name string, status string, causal_score double, binary_threshold double, "
        "evaluation_metrics struct<ci:double, rmse:double, pearson:double, spearman:double, auroc:double, auprc:double, "
        "f1:double, accuracy:double, sensitivity:double, specificity:double, precision:double, threshold:double, "
        "n_positive:bigint, n_negative:bigint>, causal struct<metrics:struct<l_total:double>>"
    )
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(pattern)
    return rows.where(F.col("run_name").isNotNull()).select(
        "run_name", "status", "causal_score", "binary_threshold", "evaluation_metrics.*",
        F.col("causal.metrics.l_total").alias("l_total"), F.col("_metadata.file_path").alias("summary_path"),
    )


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def canonical_rows(data: PairData) -> DataFrame:
    """Pairs in the flat layout, with the texts of both entities."""
    left = data.left.select(F.col("key").alias("a"), F.col("content").alias(LEFT_TEXT))
    right = data.right.select(F.col("key").alias("b"), F.col("content").alias(RIGHT_TEXT))
    rows = lookup(lookup(data.pairs.select("a", "b", "y"), left, "a", data.hot["a"]), right, "b", data.hot["b"])
    return rows.select(F.col("a").alias(LEFT_ID), LEFT_TEXT, F.col("b").alias(RIGHT_ID), RIGHT_TEXT, F.col("y").alias(VALUE))


def write_canonical(data: PairData, path: str) -> None:
    """Flat CSV part files, readable by :func:`read_regression` and :func:`read_affinity`."""
    canonical_rows(data).write.option("header", True).csv(path)
