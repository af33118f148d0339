"""Factorisation score fused with a sparse cross-attention prior between the two sides' string features.

Attention rows and columns sum over the whole grid. Entities with equal features have equal logits, so the sums run
over distinct feature vectors weighted by their multiplicity, block by block; the grid is never listed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadic.functions.hashing import gaussian_matrix
from dyadic.functions.numeric import FLOOR
from dyadic.operators.blocks import BLOCK, best_of_each, best_per_row, block_pairs, matrix, reduce_blocks
from dyadic.operators.graph import merge_equal, with_groups
from dyadic.operators.least_squares import fit_linear, linear_value
from dyadic.operators.pairs import PairData
from dyadic.operators.skew import find_hot_keys, lookup
from dyadic.predictors import factorization
from dyadic.predictors.base import (
    Prediction, attach, clip_if_binary, hashed_sides, normalize_objective, target_cells,
)
from dyadic.session import cut_lineage

FEATURES = 16
TOP_K = 8
INITIAL_SCALE = 0.1
SIDED = "side string, id string, value double"


def _sided(left_ids, left_values, right_ids, right_values) -> pd.DataFrame:
    return pd.DataFrame({
        "side": ["a"] * len(left_ids) + ["b"] * len(right_ids),
        "id": list(left_ids) + list(right_ids),
        "value": np.concatenate([left_values, right_values]),
    })


def attention_lists(data: PairData, config: dict, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``members(key, group)`` of the left side and ``lists(group, dst, w)``: the row-normalised top-k attention.

    Three passes over block pairs: row and column maxima, their softmax denominators, the best entries.
    """
    width, seed = max(1, int(config.get("latent_dim", 32))), int(config.get("seed", 42))
    top_k = max(1, int(config.get("top_k", TOP_K)))
    temperature = max(1e-6, float(config.get("attention_temperature", 1.0)))
    scale = max(np.sqrt(float(width)) * temperature, 1e-8)
    query = np.array(gaussian_matrix(seed, "query", FEATURES, width)) * INITIAL_SCALE
    keys = np.array(gaussian_matrix(seed, "keys", FEATURES, width)) * INITIAL_SCALE

    def logits(row: pd.Series) -> np.ndarray:
        q = np.tanh(matrix(row.l_flat, len(row.l_ids)) @ query)
        k = np.tanh(matrix(row.r_flat, len(row.r_ids)) @ keys)
        return (q @ k.T) / scale

    left_features, right_features = hashed_sides(data)
    left = cut_lineage(merge_equal(left_features, 1))
    right = cut_lineage(merge_equal(right_features, top_k))

    def peaks(row: pd.Series) -> pd.DataFrame:
        x = logits(row)
        return _sided(row.l_ids, x.max(axis=1), row.r_ids, x.max(axis=0))

    def exponentials(row: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        x = logits(row)
        by_row = np.exp(np.maximum(x - np.asarray(row.l_peak, dtype=float)[:, None], -50.0))
        by_col = np.exp(np.maximum(x - np.asarray(row.r_peak, dtype=float)[None, :], -50.0))
        return by_row, by_col

    def denominators(row: pd.Series) -> pd.DataFrame:
        by_row, by_col = exponentials(row)
        return _sided(row.l_ids, by_row @ np.asarray(row.r_n, dtype=float),
                      row.r_ids, np.asarray(row.l_n, dtype=float) @ by_col)

    def best(row: pd.Series) -> pd.DataFrame:
        by_row, by_col = exponentials(row)
        attn = 0.5 * (by_row / np.asarray(row.l_total, dtype=float)[:, None]
                      + by_col / np.asarray(row.r_total, dtype=float)[None, :])
        ids, others = np.asarray(row.l_ids, dtype=object), np.asarray(row.r_ids, dtype=object)
        rows, cols = best_per_row(attn, others.astype(str), top_k)
        return pd.DataFrame({"id": ids[rows], "other": others[cols], "attn": attn[rows, cols]})

    def annotate(groups: DataFrame, found: DataFrame, side: str, name: str) -> DataFrame:
        values = found.where(F.col("side") == side).select("id", F.col("value").alias(name))
        return groups.join(values, "id")

    def merged(how: str):
        return lambda found: found.groupby(["side", "id"], sort=False)["value"].agg(how).reset_index()

    found = reduce_blocks(block_pairs(left, right, block), peaks, SIDED, merged("max"), block)
    found = cut_lineage(found.groupBy("side", "id").agg(F.max("value").alias("value")))
    left, right = annotate(left, found, "a", "peak"), annotate(right, found, "b", "peak")
    found = reduce_blocks(block_pairs(left, right, block, ["n", "peak"], ["n", "peak"]), denominators, SIDED, merged("sum"), block)
    found = cut_lineage(
        found.groupBy("side", "id").agg(F.greatest(F.sum("value"), F.lit(FLOOR)).alias("value"))
    )
    left, right = annotate(left, found, "a", "total"), annotate(right, found, "b", "total")
    extra = ["peak", "total"]
    winners = reduce_blocks(block_pairs(left, right, block, extra, extra), best, "id string, other string, attn double",
                            best_of_each(top_k, "attn"), block)

    def first(frame: DataFrame, tie: str) -> DataFrame:
        order = W.partitionBy("id").orderBy(F.col("attn").desc(), tie)
        return frame.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= top_k).drop("_at")

    # one text may be on the list of nearly every other: salt it like a hot key
    candidates = cut_lineage(first(winners, "other"))
    hot = find_hot_keys(candidates, ["other"])["other"]
    members_of = right.select(F.col("id").alias("other"), "members")
    entities = lookup(candidates, members_of, "other", hot, ["id"], "inner").select("id", "attn", F.explode("members").alias("dst"))
    kept = first(entities, "dst")
    sums = kept.groupBy("id").agg(F.greatest(F.sum("attn"), F.lit(FLOOR)).alias("_sum"))
    lists = kept.join(sums, "id").select(F.col("id").alias("group"), "dst", (F.col("attn") / F.col("_sum")).alias("w"))
    members = with_groups(left_features, left.select("vec", F.col("id").alias("group"))).select("key", "group")
    return cut_lineage(members), cut_lineage(lists)


def with_attention(data: PairData, cells: DataFrame, members: DataFrame, lists: DataFrame) -> DataFrame:
    """Add ``attn`` to (a, b) cells, 0 outside the top-k lists."""
    grouped = attach(data, cells, "a", members)
    links = lists.withColumnRenamed("dst", "b").withColumnRenamed("w", "_w")
    return grouped.join(links, ["group", "b"], "left").withColumn("attn", F.coalesce("_w", F.lit(0.0))).drop("_w", "group")


def predict(data: PairData, targets: DataFrame | None = None, config: dict | None = None) -> Prediction:
    config = config or {}
    objective = normalize_objective(config.get("objective", "auto"))
    factors, _, n = factorization.fit(data, config)
    history = factorization.loss_curve(factors, n)
    members, lists = attention_lists(data, config)

    def design(cells: DataFrame) -> DataFrame:
        return with_attention(data, factorization.score_cells(cells, factors, "mf"), members, lists)

    train = data.train.select("a", "b", "y")
    if targets is None:  # the training pairs are among those to score
        scored = cut_lineage(design(data.pairs))
        beta, used = fit_linear(data.with_pairs(scored).train, ["mf", "attn"], "y")
    else:
        scored = design(target_cells(data, targets))
        beta, used = fit_linear(design(train), ["mf", "attn"], "y")
    score = F.col("mf") if used == 0 else linear_value(beta, ["mf", "attn"])
    return Prediction(
        scored.select("a", "b", clip_if_binary(score, objective, train).alias("y_hat")), history, None
    )

