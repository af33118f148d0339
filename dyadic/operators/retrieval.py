"""The best right entities of every left entity by ``bias + bias + <vec, vec>``, without visiting the grid.

Both sides have rows (key, vec, bias). Right entities are put in order of what they can reach at most and dealt into
stripes. Every left entity meets the first stripe; its k-th best score there is a floor. By Cauchy-Schwarz a stripe
cannot bring a left entity more than ``bias + largest bias + norm * largest norm``, so only those (entity, stripe)
combinations are made that can pass the floor, and inside a task the floor goes on rising from slice to slice (see
:mod:`dyadic.operators.best`). What leaves a task is k rows for each left entity. Known pairs go to the task of their
block and stripe and are struck out there; they travel as one list of small numbers for each left entity and stripe.

A vector is copied once for each block or stripe of the other side, so both are as large as a task can hold beside a
second one. Blocks are smaller where left entities have many known pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadic.functions.vectors import dot
from dyadic.operators.best import SLACK, SLICE, best_entries
from dyadic.operators.blocks import BLOCK
from dyadic.operators.ordering import measure_ranges
from dyadic.operators.packing import packed, unpacked
from dyadic.operators.skew import HotKeys, lookup
from dyadic.session import cut_lineage

DIGITS = 9
#: Numbers of a block or a stripe, and known pairs of a task.
NUMBERS, STRUCK = 1 << 21, 1 << 21
RESULT = pa.schema([("a", pa.string()), ("b", pa.string()), ("score", pa.float64())])


@dataclass(frozen=True)
class Stripes:
    """Ranges of right entities by reach, from the highest down, each in one or more stripes of about equal size."""

    buckets: list[tuple[int, int, int, float, float]]  # bucket, first stripe, number of stripes, largest bias, largest norm

    def of(self, bucket: Column, key: Column) -> Column:
        named = lambda field: F.create_map(*[F.lit(x) for r in self.buckets for x in (r[0], r[field])])[bucket]
        return named(1) + F.pmod(F.xxhash64(key), named(2)).cast("int")

    def reachable(self, bias: Column, norm: Column, floor: Column) -> Column:
        """Stripes after the first one that could bring a left entity to its floor or above."""
        bounds = F.array(*[F.struct(F.lit(at).alias("first"), F.lit(at + n - 1).alias("last"), F.lit(b).alias("bias"), F.lit(s).alias("norm"))
                           for _, at, n, b, s in self.buckets])
        open_ = F.filter(bounds, lambda s: bias + s["bias"] + norm * s["norm"] + SLACK >= floor)
        return F.filter(F.flatten(F.transform(open_, lambda s: F.sequence(s["first"], s["last"]))), lambda s: s > 0)


def striped(right: DataFrame, typical: float, stripe: int) -> tuple[DataFrame, Stripes]:
    """``right`` with its norm, stripe and ``no``, the place of its key in the stripe. Equal reaches are split by hash, so
    a stripe has a bounded size."""
    reach = F.col("bias") + F.lit(typical) * F.col("norm")
    rows = cut_lineage(right.withColumn("norm", F.sqrt(dot("vec", "vec"))).withColumn("reach", reach))
    _, ranges = measure_ranges(rows, ["reach"], rows_per_range=stripe)
    bucketed = rows.withColumn("bucket", ranges["reach"].bucket("reach").cast("int"))
    found = bucketed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("bias").alias("bias"), F.max("norm").alias("norm"))
    at, buckets = 0, []
    for r in found.orderBy(F.col("bucket").desc()).collect():  # one row for each range
        pieces = -(-r.n // stripe)
        buckets.append((r.bucket, at, pieces, r.bias, r.norm))
        at += pieces
    stripes = Stripes(buckets)
    placed = bucketed.withColumn("stripe", stripes.of(F.col("bucket"), F.col("key")))
    numbered = placed.withColumn("no", F.dense_rank().over(W.partitionBy("stripe").orderBy("key")) - 1)
    return cut_lineage(numbered.select("key", "vec", "bias", "norm", "reach", "stripe", "no")), stripes


def best_in_stripe(facts: pa.Table, stripe: pa.Table, k: int) -> pa.Table:
    """The k best unknown right entities of each left row in one stripe, at or above its floor."""
    if not len(facts) or not len(stripe):
        return RESULT.empty_table()
    facts, stripe = unpacked(facts), unpacked(stripe)
    given = pc.is_valid(facts.column("others"))
    rows, known = facts.filter(pc.invert(given)), facts.filter(given).select(["key", "others"])
    del facts
    if not len(rows):
        return RESULT.empty_table()
    names, others = rows.column("key").combine_chunks(), stripe.column("key").combine_chunks()
    vectors = lambda table: table.column("vec").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
    rank = np.empty(len(others), dtype=np.int64)
    rank[pc.array_sort_indices(others).to_numpy()] = np.arange(len(others))
    number = stripe.column("no").to_numpy()
    first = np.zeros(number.max() + 1, dtype=np.int32)
    first[number[::-1]] = np.arange(len(number), dtype=np.int32)[::-1]
    at = pc.index_in(known.column("key"), value_set=names)
    known, at = known.filter(pc.is_valid(at)), at.filter(pc.is_valid(at)).to_numpy()
    lists = known.column("others").combine_chunks()
    struck = np.repeat(at, pc.list_value_length(lists).to_numpy()), first[lists.flatten().to_numpy()]
    row, column, score = best_entries(vectors(rows), vectors(stripe), k, rank, rows.column("bias").to_numpy(), stripe.column("bias").to_numpy(),
                                      rows.column("floor").to_numpy(), struck, DIGITS, columns=SLICE)
    return pa.table({"a": names.take(pa.array(row)), "b": others.take(pa.array(column)), "score": score}, schema=RESULT)


def top_unknown(left: DataFrame, right: DataFrame, known: DataFrame | None, k: int, hot: HotKeys | None = None,
                block: int | None = None, stripe: int | None = None) -> DataFrame:
    """(a, b, score, rank): per left entity its ``k`` best right entities that are not known pairs.

    Scores are rounded to nine digits; equal ones go by the smaller b. Fewer than k rows mean that no more are unknown.
    ``block`` and ``stripe`` are rows of each side in a task; by default what gives every core work, up to ``NUMBERS``.
    """
    schema = "a string, b string, score double"
    left = cut_lineage(left.select("key", "vec", "bias").withColumn("norm", F.sqrt(dot("vec", "vec"))))
    facts = left.agg(F.coalesce(F.avg("norm"), F.lit(0.0)).alias("typical"), F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    spark = left.sparkSession
    if right.isEmpty():
        return spark.createDataFrame([], schema + ", rank int")
    most = max(BLOCK, NUMBERS // max(facts.width or 1, 1))
    right, stripes = striped(right, facts.typical, stripe or most)
    block = block or min(most, max(BLOCK, -(-facts.n // (2 * spark.sparkContext.defaultParallelism))))
    blocks, struck = -(-facts.n // block) or 1, None
    if known is not None:
        placed = lookup(known.select("a", "b"), right.select(F.col("key").alias("b"), "stripe", "no"), "b", hot, ["a"], how="inner")
        struck = cut_lineage(placed.groupBy(F.col("a").alias("key"), "stripe").agg(F.collect_list("no").alias("others")))
        fullest = struck.groupBy("stripe").agg(F.sum(F.size("others")).alias("n")).agg(F.max("n").alias("n")).first().n or 0
        blocks = max(blocks, min(-(-fullest // STRUCK), facts.n))
    block_of = lambda key: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block")
    no = lambda name, kind: F.lit(None).cast(kind).alias(name)

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        return best_in_stripe(rows, own, k)

    def search(entities: DataFrame, stripe_test: Column) -> DataFrame:
        facts = entities.select(block_of("key"), "stripe", "key", "vec", "bias", "floor", no("others", "array<int>"))
        if struck is not None:
            facts = facts.unionByName(struck.where(stripe_test).select(
                block_of("key"), "stripe", "key", no("vec", "array<double>"), no("bias", "double"), no("floor", "double"), "others"))
        own = right.where(stripe_test).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        at = ["block", "stripe"]
        facts = packed(facts, at, ["key", "vec", "bias", "floor", "others"], ["key"])
        own = packed(own, at, ["key", "vec", "bias", "no"], ["key"])
        return facts.groupBy(*at).cogroup(own.groupBy(*at)).applyInArrow(run, schema)

    lowest = F.lit(float("-inf"))
    first = cut_lineage(search(left.withColumn("stripe", F.lit(0)).withColumn("floor", lowest), F.col("stripe") == 0))
    floors = first.groupBy(F.col("a").alias("key")).agg(F.min("score").alias("_low"), F.count("*").alias("_n"))
    open_ = left.join(floors, "key", "left").withColumn("floor", F.when(F.col("_n") >= k, F.col("_low")).otherwise(lowest))
    rest = open_.withColumn("stripe", F.explode(stripes.reachable(F.col("bias"), F.col("norm"), F.col("floor"))))
    found = first.unionByName(search(cut_lineage(rest), F.col("stripe") > 0))
    order = W.partitionBy("a").orderBy(F.col("score").desc(), "b")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
