"""Frozen-vector similarity fused with marginal means and calibrated by least squares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.functions.hashing import gaussian_matrix
from dyadic.functions.numeric import clip
from dyadic.functions.text import hash_map, hash_vector
from dyadic.functions.vectors import unit
from dyadic.operators.least_squares import fit_linear, linear_value
from dyadic.operators.marginals import attach_marginals
from dyadic.operators.pair_dots import pair_dots
from dyadic.operators.pairs import PairData
from dyadic.operators.splits import sample_exact
from dyadic.predictors.base import Prediction, target_cells
from dyadic.session import cut_lineage

DEFAULT_WIDTH = 768
CALIBRATION = ["base", "sim", "row_mean", "col_mean"]


def lookup_embeddings(entities: DataFrame, table: DataFrame | None, width: int | None = None,
                      key: str = "key", vector: str = "embedding") -> DataFrame:
    """``(key, vec, is_missing)``: the stored vector of each entity, or its string hash at the table's width.

    Vectors are found by key only; their order in the table never matters. Of several vectors of a key the largest
    counts. A table of vectors of different widths raises. ``width`` counts where there is no stored vector.
    """
    if table is None:
        hashed = hash_vector(F.coalesce("content", F.lit("")), width or DEFAULT_WIDTH)
        return entities.select("key", hashed.alias("vec"), F.lit(True).alias("is_missing"))
    stored = table.select(F.col(key).cast("string").alias("key"), F.col(vector).cast("array<double>").alias("_v"))
    sizes = stored.where("_v is not null").agg(F.min(F.size("_v")).alias("low"), F.max(F.size("_v")).alias("high")).first()
    if sizes.low != sizes.high:
        raise ValueError(f"stored vectors have between {sizes.low} and {sizes.high} components")
    hashed = hash_vector(F.coalesce("content", F.lit("")), sizes.low or width or DEFAULT_WIDTH)
    stored = stored.groupBy("key").agg(F.max("_v").alias("_v"))
    joined = entities.join(stored, "key", "left")
    return joined.select(
        "key",
        F.when(F.col("_v").isNull(), hashed).otherwise(F.col("_v")).alias("vec"),
        F.col("_v").isNull().alias("is_missing"),
    )


def missing_embeddings(entities: DataFrame, table: DataFrame, key: str = "key") -> DataFrame:
    """Entities without a stored vector."""
    return entities.join(table.select(F.col(key).cast("string").alias("key")), "key", "left_anti")


def project(vectors: DataFrame, seed: int, tag: str, width_in: int, width_out: int) -> DataFrame:
    """``(key, vec)`` mapped to ``width_out`` dimensions by a seeded Gaussian matrix over sqrt(width_in).

    The matrix has ``width_in * width_out`` numbers, whatever the number of vectors, and is sent to the tasks once.
    """
    matrix = np.array(gaussian_matrix(seed, tag, width_out, width_in)).T / max(width_in, 1) ** 0.5
    shared = vectors.sparkSession.sparkContext.broadcast(matrix)
    rows = vectors.select("key", F.col("vec").cast("array<double>").alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("vec").flatten().to_numpy().reshape(len(batch), width_in) @ shared.value
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * width_out)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], ["key", "vec"])

    return rows.mapInArrow(run, rows.schema)


def _width(vectors: DataFrame) -> int:
    row = vectors.select(F.size("vec").alias("n")).first()
    return row.n if row else 0


def view_similarity(data: PairData, cells: DataFrame, config: dict) -> DataFrame:
    """Add ``sim``, the shifted cosine of the two frozen vectors."""
    tables = config.get("left_vectors"), config.get("right_vectors")
    if tables == (None, None):
        # Both sides fall back to hashed strings of equal width: only components in use on both sides add to a product.
        sparse = [cut_lineage(side.select("key", hash_map(F.coalesce("content", F.lit("")), DEFAULT_WIDTH).alias("v")))
                  for side in (data.left, data.right)]
        used = [side.select(F.explode(F.map_keys("v")).alias("i")).distinct() for side in sparse]
        common = [r.i for r in used[0].join(used[1], "i").orderBy("i").collect()]  # at most DEFAULT_WIDTH
        dense = F.array(*[F.coalesce(F.try_element_at("v", F.lit(i)), F.lit(0.0)) for i in common or [0]])
        left, right = (cut_lineage(side.select("key", dense.alias("vec"))) for side in sparse)
        return pair_dots(cells, left, right).withColumn("sim", clip((F.col("dot") + 1.0) * 0.5, 0.0, 1.0)).drop("dot")
    left = lookup_embeddings(data.left, tables[0]).select("key", "vec")
    right = lookup_embeddings(data.right, tables[1]).select("key", "vec")
    width_left, width_right = _width(left), _width(right)
    if width_left != width_right:
        shared, seed = min(width_left, width_right), int(config.get("seed", 42))
        left = project(left, seed, "left", width_left, shared)
        right = project(right, seed, "right", width_right, shared)
    left, right = (cut_lineage(side.select("key", unit("vec").alias("vec"))) for side in (left, right))
    return pair_dots(cells, left, right).withColumn("sim", clip((F.col("dot") + 1.0) * 0.5, 0.0, 1.0)).drop("dot")


def design(data: PairData, cells: DataFrame, config: dict) -> DataFrame:
    """Add sim, the marginal means and the fused ``base`` score."""
    alpha = min(1.0, max(0.0, float(config.get("fusion_alpha", 0.7))))
    cells = attach_marginals(data, view_similarity(data, cells, config))
    stats = 0.5 * F.col("row_mean") + 0.5 * F.col("col_mean")
    base = F.lit(alpha) * F.col("sim") + F.lit(1.0 - alpha) * stats
    return cells.withColumn("base", clip(base, 0.0, 1.0))


def predict(data: PairData, targets: DataFrame | None = None, config: dict | None = None) -> Prediction:
    """Calibration uses every training pair unless ``max_calibration_samples`` asks for an exact-size sample."""
    config = config or {}
    train_cells = data.train.select("a", "b", "y")
    cap = config.get("max_calibration_samples")
    if cap is None and targets is None:  # the training pairs are among those to score
        scored = cut_lineage(design(data, data.pairs, config))
        train_rows = data.with_pairs(scored).train
    else:
        scored = design(data, target_cells(data, targets), config)
        train_rows = None
    if cap is not None:
        train_cells = sample_exact(train_cells, ["a", "b"], max(1000, int(cap)), int(config.get("seed", 42)))
    beta, n = fit_linear(design(data, train_cells, config) if train_rows is None else train_rows, CALIBRATION, "y")
    score = F.col("base") if n == 0 else clip(linear_value(beta, CALIBRATION), 0.0, 1.0)
    return Prediction(scored.select("a", "b", score.alias("y_hat")))
