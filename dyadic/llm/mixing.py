"""Mixing sources to target weights by temperature.

Source shares of tokens, raised to an exponent and normalised, are the weights. The exponent is the smallest at which
the entropy of the weights is at most ``entropy`` times its largest value and no source is repeated more than
``max_repeat`` times. Below 1 it flattens the shares, above 1 it sharpens them; where even the natural shares are too
flat for the target, it is therefore above 1. It is bracketed among powers of two up to ``LARGEST`` and found by
bisection over the table of source totals; each round is one aggregation that halves the interval ``HALVINGS`` times
at once, so only a few numbers reach the driver. If no exponent meets the entropy within the limit of repeats, the
largest one within the limit is taken. The result says which target held the exponent (``held``): ``entropy``,
``repetition``, ``none`` (the flattest weights meet both) or ``unmet``.

Weights become token budgets. Each pass over a source goes through its blocks (hash buckets of documents) in an order
of its own; the budget ends in one block, inside which documents are taken in hash order while they fit. Totals of the
block's 4,096 parts tell in which part that is, so no task orders a whole block.

All passes are decided by tables of (source, pass, block), which are small; documents are read once and never ordered
as a whole. Without ``budget_share`` the budget is the least at which every document is used once at least.

Defined cases: null texts and texts without words have no tokens; they cost nothing, so they follow their block. A null
source is a source of its own. Rows equal in id and text are taken or left together. Sources without tokens get no
weight; their documents appear in one pass. One source: weight 1. Sources of equal size keep equal weights whatever the
exponent, so an entropy below the largest is unmet. No exponent within the limit of repeats (a budget above it): the
natural shares, unmet. Texts are counted whole. An empty table gives an empty table. Columns of any name lie in ``row``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyadic.session import cut_lineage

BLOCKS = 64
PART_DIGITS = 3  # hexadecimal digits of the order: a block has 4,096 parts
ROUNDS, HALVINGS = 5, 6
LARGEST = 16
SMALL = 100_000  # rows of a plan that is broadcast, some 10 MB
WORD = r"[^\x20\x09-\x0D]+"


def seeded(seed: int, *parts):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def source_totals(blocks: DataFrame) -> DataFrame:
    total = blocks.agg(F.sum("tokens").alias("all"))
    return blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0").crossJoin(F.broadcast(total)).select(
        "source", "tokens", (F.col("tokens") / F.col("all")).alias("share"))  # the total is one row


def judged(totals: DataFrame, steps: list[float], entropy: float | None, max_repeat: float | None, budget: float | None) -> list[tuple[bool, bool]]:
    """Of each exponent, whether the entropy is at most its target and no source is repeated too often; empty without sources."""
    power = totals.select("share", F.posexplode(F.array(*[F.lit(float(s)) for s in steps])).alias("at", "step"))
    power = power.withColumn("w", F.pow("share", F.col("step"))).groupBy("at").agg(
        F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wlogw"), F.count("*").alias("n"),
        F.max(F.col("w") / F.col("share")).alias("most"), F.min(F.col("w") / F.col("share")).alias("least"))
    # entropy of w / z is log z - sum(w log w) / z; a source is repeated budget * w / (z * share) times
    repeats = F.col("most") / F.col("least") if budget is None else budget * F.col("most") / F.col("z")
    rows = power.select("at", "n", (F.log("z") - F.col("wlogw") / F.col("z")).alias("h"), repeats.alias("repeats")).orderBy("at").collect()
    return [
        (entropy is None or r.h <= entropy * math.log(max(r.n, 1)) + 1e-12, max_repeat is None or r.repeats <= max_repeat * (1 + 1e-12))
        for r in rows
    ]


def temperature(totals: DataFrame, entropy: float | None, max_repeat: float | None, budget: float | None) -> tuple[float, str]:
    """The exponent and what held it (see above)."""
    n = 1 << HALVINGS
    steps = [k / n for k in range(n + 1)] + [2 ** (k / 8) for k in range(1, 8 * LARGEST.bit_length() - 7)]
    flags = judged(totals, steps, entropy, max_repeat, budget)
    fits, within = [m and w for m, w in flags], [w for _, w in flags]
    if not any(within):
        return 1.0, "unmet" if flags else "none"
    if not any(fits):
        at = max(i for i, w in enumerate(within) if w)
        if at == len(steps) - 1:
            return float(steps[at]), "unmet"
        test, held = lambda m, w: not w, "unmet"
    else:
        at = fits.index(True) - 1
        if at < 0:
            return 0.0, "none"
        test, held = lambda m, w: m and w, "repetition" if flags[at][0] else "entropy"
    low, high = steps[at], steps[at + 1]
    for _ in range(ROUNDS - 1):
        steps = [low + (high - low) * k / n for k in range(n + 1)]
        found = [test(*f) for f in judged(totals, steps[1:-1], entropy, max_repeat, budget)] + [True]
        at = found.index(True)
        low, high = steps[at], steps[at + 1]
    return round(low if held == "unmet" else high, 6), held


def exponent(totals: DataFrame, entropy: float | None, max_repeat: float | None, budget: float | None) -> float:
    return temperature(totals, entropy, max_repeat, budget)[0]


def mix_sources(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", entropy: float | None = 0.95,
    max_repeat: float | None = 4.0, budget_share: float | None = None, blocks: int = BLOCKS, seed: int = 17,
) -> DataFrame:
    """Columns ``row`` (the document), tokens, weight, pass (from 1), place (rank of the block in that pass), exponent, held.

    ``budget_share`` is the budget as a multiple of all tokens. A document appears once for each pass it is in.
    """
    key = F.concat_ws("|", F.coalesce(F.concat(F.lit("="), F.col(f"`{id}`").cast("string")), F.lit("")), F.xxhash64(f"`{text}`").cast("string"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
        F.substring(seeded(seed, key), 1, 16).alias("order"),
    ).withColumn("block", F.pmod(F.xxhash64("order"), F.lit(blocks)).cast("int"))
    slim = cut_lineage(rows.select("source", "block", "tokens", "order"))
    sums = cut_lineage(slim.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")))
    totals = source_totals(sums)
    all_tokens = sums.agg(F.sum("tokens")).first()[0] or 0
    share = None if budget_share is None else float(budget_share)
    a, held = temperature(totals, entropy, max_repeat, share)
    norm = totals.agg(F.sum(F.pow("share", F.lit(a))).alias("z"), F.max(F.col("share") / F.pow("share", F.lit(a))).alias("least"))
    weight = F.pow("share", F.lit(a)) / F.col("z")
    target = weight * float(all_tokens) * (F.col("least") * F.col("z") if share is None else F.lit(share))
    plans = totals.crossJoin(F.broadcast(norm)).select(  # one row of sums
        "source", weight.alias("weight"), F.round(target).cast("long").alias("target"), F.col("tokens").alias("total"))
    plans = sums.select("source").distinct().join(plans, "source", "left").select(
        "source", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("target", F.lit(0)).alias("target"), F.coalesce("total", F.lit(0)).alias("total"))
    passes = F.when(F.col("total") > 0, F.ceil(F.col("target") / F.col("total"))).otherwise(F.lit(1))
    plans = plans.withColumn("pass", F.explode(F.when(passes > 0, F.sequence(F.lit(1), passes.cast("int")))))
    plans = plans.withColumn("left", F.least("total", F.col("target") - F.col("total") * (F.col("pass") - 1)))
    # blocks of a pass in their own order, with the tokens before each; a window holds at most ``blocks`` rows
    order = Window.partitionBy("source", "pass").orderBy("rank_key", "block")
    blocks_of = plans.join(sums, "source").withColumn("rank_key", seeded(seed, "source", F.col("pass").cast("string"), F.col("block").cast("string")))
    blocks_of = blocks_of.select(
        "source", "pass", "block", "weight", "left", "tokens", F.row_number().over(order).alias("place"),
        (F.sum("tokens").over(order) - F.col("tokens")).alias("before"))
    blocks_of = cut_lineage(blocks_of.where("before < left or left = 0 or before + tokens <= left"))
    cut = blocks_of.where("before + tokens > left").select("source", "pass", "block", (F.col("left") - F.col("before")).alias("room"))
    # the budget of a pass ends in one part of one block: only that part is ordered
    ends = cut_lineage(slim.join(cut, ["source", "block"]).withColumn("part", F.substring("order", 1, PART_DIGITS)))
    parts = ends.groupBy("source", "pass", "block", "part").agg(F.sum("tokens").alias("tokens"), F.first("room").alias("room"))
    running = Window.partitionBy("source", "pass", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("upto", F.sum("tokens").over(running)).where("upto > room").groupBy("source", "pass", "block").agg(
        F.min(F.struct("part", (F.col("upto") - F.col("tokens")).alias("spent"))).alias("last")).select("source", "pass", "block", "last.*")
    parts = cut_lineage(parts)
    inside = Window.partitionBy("source", "pass", "block").orderBy("order").rangeBetween(Window.unboundedPreceding, 0)
    used = F.col("spent") + F.sum("tokens").over(inside)
    fitting = ends.join(parts, ["source", "pass", "block", "part"]).withColumn("used", used).where("used <= room").groupBy(
        "source", "pass", "block").agg(F.max("order").alias("order"))
    # a part stands before all orders that begin with it, so without a fitting document it marks the parts before
    last = parts.join(fitting, ["source", "pass", "block"], "left").select("source", "pass", "block", F.coalesce("order", "part").alias("upto"))
    chosen = blocks_of.join(last, ["source", "pass", "block"], "left").select(
        "source", "block", "pass", "place", "weight", F.when(F.col("before") + F.col("tokens") <= F.col("left"), "~").otherwise(F.coalesce("upto", F.lit(""))).alias("upto"))
    chosen = cut_lineage(chosen)
    if chosen.limit(SMALL + 1).count() <= SMALL:
        chosen = F.broadcast(chosen)
    return rows.join(chosen, ["source", "block"]).where("order <= upto").select(
        "row", "tokens", "weight", "pass", "place", F.lit(a).alias("exponent"), F.lit(held).alias("held"))
