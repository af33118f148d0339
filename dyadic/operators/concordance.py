"""Exact concordance index without comparing all pairs.

CI is the share of pairs ordered by truth that the prediction orders the same way, ties counting half. A problem that
is too large for one task is cut into value ranges of both columns, frequent values getting ranges of their own.
A pair of rows then falls into exactly one of three cases:

* different truth range and different prediction range: decided by a histogram of the ranges alone;
* same prediction range: decided inside that range (or, for a range with a single value, a tie);
* same truth range: decided inside that range (nothing to do for a single value).

Each range is a problem of the same kind, up to ``RANGES`` times smaller, and is cut again until it fits a task,
where a merge-style count takes O(m log m). Rows are neither sampled nor capped, and no task or histogram grows with
the data. The first cut uses ranges that the driver knows; only its large ranges, if any, look theirs up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadic.functions.vectors import let
from dyadic.operators.ordering import measure_ranges
from dyadic.session import cut_lineage

LOCAL_ROWS = 1_000_000  # distinct (truth, prediction) combinations counted by one task
RANGES = 512  # a power of two
PARTS = 4 * RANGES  # numbers for the parts of a part; five levels fit a bigint
BROADCAST_PARTS = 4_096  # with two lists of RANGES - 1 bounds each: about 16 MB


def weighted_concordant(primary: np.ndarray, secondary: np.ndarray, weight: np.ndarray) -> float:
    """Weighted number of pairs with a larger primary that also have a larger secondary (ties count half).

    Dense ranks of ``primary`` differ first at exactly one bit, so each ordered pair is met once, at that bit:
    rows sharing the higher bits form a block in which the rows with a 1 are compared with those with a 0.
    """
    _, rank = np.unique(primary, return_inverse=True)
    order = np.argsort(secondary, kind="stable")
    rank, value, weight = rank[order], secondary[order], weight[order].astype(float)
    counted = 0.0
    for level in range(int(rank.max()).bit_length()):
        block = rank >> (level + 1)
        by_block = np.argsort(block, kind="stable")
        b, v = block[by_block], value[by_block]
        upper = ((rank[by_block] >> level) & 1).astype(bool)
        w = weight[by_block]
        lower_upto = np.concatenate(([0.0], np.cumsum(np.where(upper, 0.0, w))))
        new_block = np.concatenate(([True], b[1:] != b[:-1]))
        new_run = new_block | np.concatenate(([True], v[1:] != v[:-1]))
        run = np.cumsum(new_run) - 1
        run_start = np.flatnonzero(new_run)
        run_end = np.append(run_start[1:], len(b))
        block_start = np.flatnonzero(new_block)[np.cumsum(new_block) - 1]
        below = lower_upto[run_start][run] - lower_upto[block_start]
        tied = (lower_upto[run_end] - lower_upto[run_start])[run]
        counted += float(np.sum((w * (below + 0.5 * tied))[upper]))
    return counted


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(name).to_numpy() for name in names]


def _count_range(part: pa.Table) -> pa.Table:
    return pa.table({"concordant": [weighted_concordant(*_numbers(part, "u", "v", "c"))]})


def _count_histogram(cells: pa.Table) -> pa.Table:
    gu, gv, count = _numbers(cells, "gu", "gv", "c")
    rows, row_at = np.unique(gu, return_inverse=True)
    cols, col_at = np.unique(gv, return_inverse=True)
    table = np.zeros((len(rows), len(cols)))
    table[row_at, col_at] = count
    earlier_rows = np.cumsum(table, axis=0) - table
    found = float(np.sum(table * (np.cumsum(earlier_rows, axis=1) - earlier_rows)))
    single = cols % 2 == 1
    found += 0.5 * float(np.sum((table * earlier_rows)[:, single]))
    return pa.table({"concordant": [found]})


def _place(value: str, bounds: str) -> Column:
    """Range number of a value among the quantiles of its part; odd for a frequent value (a repeated quantile)."""
    strides = [2**k for k in reversed(range(RANGES.bit_length() - 1))]
    at = F.aggregate(
        F.array(*[F.lit(s) for s in strides]),
        F.lit(0),
        lambda pos, s: F.when(F.get(bounds, pos + s - 1) < F.col(value), pos + s).otherwise(pos),
    )
    repeated = lambda pos: (F.get(bounds, pos) == F.col(value)) & (F.get(bounds, pos + 1) == F.col(value))
    return let(at, lambda pos: pos * 2 + F.when(repeated(pos), 1).otherwise(0))


def _place_inside(problem: DataFrame) -> DataFrame:
    """Ranges of the rows among the quantiles of their own part."""
    probs = ", ".join(f"{i / RANGES}D" for i in range(1, RANGES))
    bounds = problem.groupBy("part").agg(
        *[F.expr(f"percentile_approx({c}, array({probs}), {4 * RANGES})").alias(f"_b{c}") for c in ("u", "v")]
    )
    bounds = cut_lineage(bounds)
    # While parts are few they are large, and their bounds are small enough to send to every task.
    bounds = F.broadcast(bounds) if bounds.count() <= BROADCAST_PARTS else bounds
    return problem.join(bounds, "part").select("part", "u", "v", "c", _place("u", "_bu").alias("gu"), _place("v", "_bv").alias("gv"))


def _parts(placed: DataFrame, *columns: Column | str) -> DataFrame:
    """Rows once for the part of their truth range and once for the part of their score range, single values left out.

    Within a score range only the order of the truth ranges counts: equal ones are compared in their truth range.
    """
    same_truth = placed.where(F.col("gu") % 2 == 0).select((F.col("part") * PARTS + F.col("gu")).alias("part"), F.col("u"), *columns)
    same_score = placed.where(F.col("gv") % 2 == 0).select(
        (F.col("part") * PARTS + F.col("gv") + 2 * RANGES).alias("part"), F.col("gu").cast("double").alias("u"), *columns
    )
    return same_truth.unionByName(same_score)


def concordance(frame: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """One row with ``ci``: 0 for fewer than two rows, 0.5 when no pair is ordered by truth."""
    n = frame.count()
    counts = frame.groupBy("y", "y_hat").agg(F.count("*").alias("c"))
    if n > local_rows:
        counts = cut_lineage(counts)
    return concordance_of_counts(counts, n, local_rows)


def concordance_of_counts(counts: DataFrame, n: int, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """:func:`concordance` of ``n`` rows from their distinct ``(y, y_hat, c)``; a large table should be a stored one."""
    schema = "concordant double"
    counts = counts.select(F.col("y").alias("u"), F.col("y_hat").alias("v"), F.col("c").cast("double").alias("c"))
    problem = counts.select(F.lit(0).cast("bigint").alias("part"), "u", "v", "c")
    parts = problem.limit(0).select(F.lit(0.0).alias("concordant"))
    large = None
    if n > local_rows:
        rows, ranges = measure_ranges(counts, ["u", "v"], max(local_rows // 4, 1), RANGES)
        if rows > local_rows:
            large = problem.withColumns({f"g{c}": ranges[c].bucket(c) for c in ("u", "v")})
    while large is not None:
        placed = cut_lineage(large)
        cells = cut_lineage(placed.groupBy("part", "gu", "gv").agg(F.sum("c").alias("c"), F.count("*").alias("rows")))
        parts = parts.unionByName(cells.groupBy("part").applyInArrow(_count_histogram, schema))
        problem, large = _parts(placed, "v", "c"), None
        sizes = _parts(cells.withColumn("u", F.lit(0.0)), "rows").groupBy("part").agg(F.sum("rows").alias("rows"))
        again = cut_lineage(sizes.where(F.col("rows") > local_rows).select("part"))
        n_again = again.count()
        if n_again:
            again = F.broadcast(again) if n_again <= BROADCAST_PARTS else again
            large = _place_inside(problem.join(again, "part", "left_semi"))
            problem = problem.join(again, "part", "left_anti")
        parts = parts.unionByName(problem.groupBy("part").applyInArrow(_count_range, schema))
        problem = None
    if problem is not None:
        parts = parts.unionByName(problem.groupBy("part").applyInArrow(_count_range, schema))
    per_truth = counts.groupBy("u").agg(F.sum("c").alias("c"))
    same_truth = per_truth.agg(F.sum(F.col("c") * F.col("c")).alias("s")).scalar()
    ordered = (F.lit(float(n)) * F.lit(float(n)) - same_truth) / 2.0
    value = (
        F.when(F.lit(n) == 0, F.lit(None).cast("double"))
        .when(F.lit(n) < 2, F.lit(0.0))
        .when(F.col("ordered") <= 0, F.lit(0.5))
        .otherwise(F.col("found") / F.greatest("ordered", F.lit(1.0)))
    )
    return (
        parts.agg(F.coalesce(F.sum("concordant"), F.lit(0.0)).alias("found"))
        .withColumn("ordered", ordered)
        .select(value.alias("ci"))
    )
