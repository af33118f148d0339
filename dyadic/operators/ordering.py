"""Global order without a single-task sort.

A window without ``partitionBy`` moves a whole table into one task. The operators here reach the same answers
in two steps: a small summary (a histogram of digests or of value ranges, bounded by a constant) says what
precedes each bucket, and the order inside a bucket is found by a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadic.functions.hashing import digest_number, seeded_digest
from dyadic.functions.vectors import let
from dyadic.session import cut_lineage

DIGEST_DIGITS = 4  # 65,536 equal digest buckets
MAX_RANGES = 1024  # value ranges of the first level; ranges that are still too large are split further
ROWS_PER_RANGE = 50_000  # below this a table is one range
STRING_RANGES = 256
STRING_SAMPLE = 8192
BOUNDS = 1024  # inner bounds by which one range is split on a further level
OVERSIZE = 20  # a range of that many times the wanted rows is split; up to there a task still sorts it well


def permutation_cutoffs(
    frame: DataFrame, keys: Sequence[str], seed: int, ranks: Callable[[int], list[int]]
) -> tuple[int, list[str]]:
    """Digests found at given ranks of the seeded permutation of ``frame``'s distinct keys.

    ``ranks(n)`` names the 1-based ranks wanted once the row count n is known. The driver sees at most 65,536
    bucket counts and one digest per rank; membership is then the row-local test ``digest <= cutoff``,
    so the table itself is neither sorted nor shuffled.
    """
    digests = frame.select(seeded_digest(seed, *keys).alias("h"))
    bucket = digest_number(F.col("h"), 1, DIGEST_DIGITS).cast("int")
    histogram = sorted(
        (r["bucket"], r["count"]) for r in digests.groupBy(bucket.alias("bucket")).count().collect()
    )
    n = sum(count for _, count in histogram)
    wanted = [r for r in ranks(n) if 1 <= r <= n]
    places: dict[tuple[int, int], int] = {}
    for rank in wanted:
        before = 0
        for number, count in histogram:
            if before + count >= rank:
                places[(number, rank - before)] = rank
                break
            before += count
    if not places:
        return n, []
    found = (
        digests.where(bucket.isin(sorted({number for number, _ in places})))
        .withColumn("bucket", bucket)
        .withColumn("pos", F.row_number().over(W.partitionBy("bucket").orderBy("h")))
        .where(reduce(or_, [(F.col("bucket") == b) & (F.col("pos") == p) for b, p in places]))
        .collect()
    )
    by_rank = {places[(r.bucket, r.pos)]: r.h for r in found}
    return n, [by_rank[r] for r in wanted]


def round_half_even(value: float) -> int:
    return int(round(value))


@dataclass(frozen=True)
class Ranges:
    """Value ranges of one column: sorted inner bounds and which of them hold a frequent single value.

    Bucket ``2 i`` covers the values between bounds i-1 and i, bucket ``2 i + 1`` exactly the frequent value
    bounds[i]. A value held by a third of all rows thus has a bucket of its own, which callers can treat by
    counting alone.
    """

    bounds: tuple
    frequent: frozenset
    capped: bool = False  # there are more rows than these ranges can hold

    def bucket(self, column: str) -> Column:
        if not self.bounds:
            return F.lit(0)
        value, steps = F.col(column), len(self.bounds).bit_length()
        bounds = self._array(self.bounds)
        # Binary search: the number of bounds below the value, built up from halving strides.
        position = F.aggregate(
            F.array(*[F.lit(2**k) for k in reversed(range(steps))]),
            F.lit(0),
            lambda at, stride: F.when(F.get(bounds, at + stride - 1) < value, at + stride).otherwise(at),
        )
        # Never null, but only a coalesce tells the optimizer, which else tests every row below a join or sum for it.
        if not self.frequent:
            return F.coalesce(position * 2, F.lit(0))
        flags = self._array([v if v in self.frequent else None for v in self.bounds])
        return F.coalesce(let(position, lambda at: at * 2 + F.when(F.get(flags, at) == value, 1).otherwise(0)), F.lit(0))

    @staticmethod
    def is_single(bucket: Column) -> Column:
        return bucket % 2 == 1

    @staticmethod
    def _array(values: Sequence) -> Column:
        if any(isinstance(v, str) for v in values):
            return F.array(*[F.lit(v) for v in values])
        return F.split(F.lit(",".join("" if v is None else repr(float(v)) for v in values)), ",").try_cast(
            "array<double>"
        )


def _ranges(quantiles: Sequence, parts: int, capped: bool = False) -> Ranges:
    """Thin out evenly spaced quantiles to ``parts`` ranges; a repeated quantile marks a frequent value."""
    if parts <= 1 or not quantiles:
        return Ranges((), frozenset())
    step = (len(quantiles) + 1) // parts or 1
    picked = list(quantiles[step - 1 :: step])
    frequent = {v for v, w in zip(picked, picked[1:]) if v == w}
    return Ranges(tuple(sorted(set(picked))), frozenset(frequent), capped)


def measure_ranges(
    frame: DataFrame, columns: Sequence[str], rows_per_range: int = ROWS_PER_RANGE, max_ranges: int = MAX_RANGES
) -> tuple[int, dict[str, Ranges]]:
    """Row count and balanced ranges of numeric columns; a table of one range's size is only counted."""
    n = frame.count()
    if n <= rows_per_range:
        return n, {c: Ranges((), frozenset()) for c in columns}
    probs = ", ".join(f"{i / max_ranges}D" for i in range(1, max_ranges))
    row = frame.agg(
        *[F.expr(f"percentile_approx({c}, array({probs}), {4 * max_ranges})").alias(c) for c in columns]
    ).first()
    parts = math.ceil(n / rows_per_range)
    return n, {c: _ranges(row[c] or [], min(max_ranges, parts), parts > max_ranges) for c in columns}


def string_ranges(frame: DataFrame, column: str, sample: int = STRING_SAMPLE) -> Ranges:
    """Balanced ranges of a distinct string column from the rows with the smallest hashes (bounded sample)."""
    rows = frame.select(column).orderBy(F.xxhash64(column), column).limit(sample).collect()
    if len(rows) < sample:
        return Ranges((), frozenset())
    values = sorted((r[0] for r in rows), key=lambda s: s.encode())
    step = sample // STRING_RANGES
    return Ranges(tuple(values[step::step]), frozenset(), True)


def refine(keyed: DataFrame, key: str, levels: list[str], limit: int) -> tuple[DataFrame, list[str]]:
    """Split buckets of more than ``limit`` rows, level by level, until none is left. Keys are distinct.

    A bucket is split at a hash sample of its own keys. Each level adds a column; a bucket is named by all of them, and
    the buckets within one parent are bounded by ``BOUNDS``.
    """
    while True:
        big = cut_lineage(keyed.groupBy(*levels).agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit))
        if big.isEmpty():
            return keyed, levels
        share = F.least(F.lit(BOUNDS), F.ceil(F.lit(OVERSIZE) * F.col("_rows") / limit)) / F.col("_rows")
        drawn = F.pmod(F.xxhash64(key, F.lit(len(levels))), F.lit(1 << 40)) / float(1 << 40)
        sample = keyed.join(big, levels).where(drawn < share)
        bounds = sample.groupBy(*levels).agg(F.slice(F.sort_array(F.collect_list(key)), 1, 4 * BOUNDS - 1).alias("_bounds"))
        strides = F.array(*[F.lit(2**k) for k in reversed(range((4 * BOUNDS).bit_length()))])
        below = F.aggregate(strides, F.lit(0), lambda at, by: F.when(F.get("_bounds", at + by - 1) < F.col(key), at + by).otherwise(at))
        name = f"_g{len(levels)}"
        keyed = cut_lineage(keyed.join(cut_lineage(bounds), levels, "left").withColumn(name, F.coalesce(below, F.lit(0))).drop("_bounds"))
        levels = [*levels, name]


def offsets_before(totals: DataFrame, levels: list[str], outs: list[str], descending: Sequence[str] = ()) -> DataFrame:
    """Per bucket the sums (``_o_<out>``) over all buckets before it, from its totals (``_t_<out>``).

    Every level orders the buckets of one parent, so no window sees all buckets of a deep hierarchy.
    """
    found = totals.select(*levels)
    for depth, level in enumerate(levels):
        parents, own = levels[:depth], levels[: depth + 1]
        at = totals if own == levels else totals.groupBy(*own).agg(*[F.sum(f"_t_{o}").alias(f"_t_{o}") for o in outs])
        before = W.partitionBy(*parents).orderBy(F.col(level).desc() if level in descending else F.col(level)).rowsBetween(W.unboundedPreceding, -1)
        part = at.select(*own, *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_p{depth}_{o}") for o in outs])
        found = found.join(part, own)
    return found.select(*levels, *[reduce(lambda x, y: x + y, [F.col(f"_p{d}_{o}") for d in range(len(levels))]).alias(f"_o_{o}") for o in outs])


def prefix_sums(
    grouped: DataFrame, key: str, sums: dict[str, str], ranges: Ranges, descending: bool = False, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Add running totals (including the row itself) over the global order of a *distinct* key.

    ``sums`` maps output column to input column. ``grouped`` has one row per key value, so no bucket can be
    dominated by a repeated value, and a bucket that is too large can always be split.
    """
    order = F.col(key).desc() if descending else F.col(key).asc()
    keyed, levels = grouped.withColumn("_g0", ranges.bucket(key)), ["_g0"]
    if ranges.bounds or ranges.capped:  # stored, for it is read for the totals and for the sums inside a bucket
        keyed = cut_lineage(keyed)
    if ranges.capped:
        keyed, levels = refine(keyed, key, levels, OVERSIZE * rows_per_range)
    inside = W.partitionBy(*levels).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = keyed.select("*", *[F.sum(src).over(inside).alias(out) for out, src in sums.items()])
    if not ranges.bounds and len(levels) == 1:
        return local.drop("_g0")
    totals = cut_lineage(keyed.groupBy(*levels).agg(*[F.sum(src).alias(f"_t_{out}") for out, src in sums.items()]))
    offsets = offsets_before(totals, levels, list(sums), levels if descending else ())
    if not ranges.capped:  # at most 2 * MAX_RANGES + 1 rows
        offsets = F.broadcast(offsets)
    joined = local.join(offsets, levels)
    return joined.select(*grouped.columns, *[(F.col(out) + F.col(f"_o_{out}")).alias(out) for out in sums])


def sorted_position(frame: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """0-based position of every distinct string key in sorted order."""
    ranges = string_ranges(frame, key)
    counted = prefix_sums(frame.withColumn("_one", F.lit(1)), key, {out: "_one"}, ranges)
    return counted.drop("_one").withColumn(out, (F.col(out) - 1).cast("int"))
