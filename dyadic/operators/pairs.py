"""The pair table ``(a, b, y)`` and its two entity tables: cleaning results, dedup, index, grid.

Missing pairs are absent rows. The dense convention (a value for every cell) is available through
:func:`densify`, whose output size is by definition the number of cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadic.operators.ordering import sorted_position
from dyadic.operators.skew import HotKeys, find_hot_keys

GRID_BLOCK = 4096  # entities per side of a grid block


@dataclass(frozen=True)
class PairData:
    """Known pairs with their folds and the entities of both sides.

    ``pairs``: a, b, y and, after a split, fold. ``left`` / ``right``: key, content.
    """

    pairs: DataFrame
    left: DataFrame
    right: DataFrame
    meta: dict = field(default_factory=dict)
    shared: dict = field(default_factory=dict, repr=False)  # results that depend on the entities only

    @cached_property
    def size(self) -> int:
        return self.pairs.count()

    @cached_property
    def hot(self) -> dict[str, HotKeys]:
        return find_hot_keys(self.pairs, ["a", "b"], at_most=self.size)

    @property
    def train(self) -> DataFrame:
        if "fold" in self.pairs.columns:
            return self.pairs.where(F.col("fold") == "train")
        return self.pairs

    def with_pairs(self, pairs: DataFrame) -> PairData:
        return PairData(pairs, self.left, self.right, dict(self.meta), self.shared)


def last_write(rows: DataFrame, keys: list[str], value: Column | str, order: list[str], out: str = "y") -> DataFrame:
    """Value of the last row of every key; partial aggregation collapses repeated pairs before the shuffle."""
    value = F.col(value) if isinstance(value, str) else value
    order_key = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return rows.groupBy(*keys).agg(F.max_by(value, order_key).alias(out))


def first_content(rows: DataFrame, key: str, content: str, order: list[str]) -> DataFrame:
    """Content of the first row of every key."""
    order_key = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return rows.groupBy(F.col(key).alias("key")).agg(F.min_by(content, order_key).alias("content"))


def entity_index(entities: DataFrame) -> DataFrame:
    """0-based position of each key in string order ("10" before "2")."""
    return sorted_position(entities.select("key").distinct(), "key")


def grid(left: DataFrame, right: DataFrame, block: int = GRID_BLOCK, limit: int | None = None) -> DataFrame:
    """Every (a, b) cell, the shape of a dense result.

    Both key sets are dealt into blocks and each left block is matched with each right block by an equi-join
    on the block pair, so a task holds ``block**2`` cells however large a side is. Nothing is broadcast and
    no task sees a whole side. A caller can have more than ``limit`` cells refused.
    """
    n_left, n_right = left.count(), right.count()
    if limit is not None and n_left * n_right > limit:
        raise ValueError(f"grid of {n_left} x {n_right} cells exceeds the limit of {limit}")
    blocks_left, blocks_right = max(1, math.ceil(n_left / block)), max(1, math.ceil(n_right / block))
    rows = left.select(
        F.col("key").alias("a"),
        F.pmod(F.xxhash64("key"), F.lit(blocks_left)).alias("_i"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks_right - 1)).cast("array<bigint>")).alias("_j"),
    )
    cols = right.select(
        F.col("key").alias("b"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks_left - 1)).cast("array<bigint>")).alias("_i"),
        F.pmod(F.xxhash64("key"), F.lit(blocks_right)).alias("_j"),
    )
    return rows.join(cols, ["_i", "_j"]).select("a", "b")


def densify(cells: DataFrame, pairs: DataFrame, fill: str = "zero") -> DataFrame:
    """Attach known values to all cells; the rest become 0 (``fill='zero'``) or NULL (``fill='null'``)."""
    if fill not in ("zero", "null"):
        raise ValueError(f"fill must be 'zero' or 'null', not {fill!r}")
    joined = cells.join(pairs.select("a", "b", "y"), ["a", "b"], "left")
    return joined.withColumn("y", F.coalesce("y", F.lit(0.0))) if fill == "zero" else joined


def melt_matrix(lines: DataFrame, row_key: str, values: str) -> DataFrame:
    """Dense rows (an array per row) to long ``(row, col, value)``."""
    return lines.select(F.col(row_key).alias("row"), F.posexplode(values).alias("col", "value"))
