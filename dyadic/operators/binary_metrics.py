"""Quality of scores against binary truth: confusion metrics, AUROC, AUPRC.

Inputs carry ``y`` (truth, positive from 0.5 up), ``y_hat`` (score) and, for AUPRC, key columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadic.functions.hashing import digest_number, seeded_digest
from dyadic.functions.numeric import safe_divide
from dyadic.operators.ordering import Ranges, measure_ranges, prefix_sums
from dyadic.operators.regression_metrics import finite_pairs
from dyadic.session import cut_lineage

TIE_DIGITS, TIE_ROWS = 2, 200_000  # a score with more rows is dealt into pieces of 256 on each level


def confusion(frame: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of counts and the metrics that follow from them."""
    truth, label = F.col("y") >= 0.5, F.col("y_hat") >= F.lit(float(threshold))
    counts = frame.agg(
        F.count_if(truth & label).alias("tp"), F.count_if(~truth & label).alias("fp"),
        F.count_if(~truth & ~label).alias("tn"), F.count_if(truth & ~label).alias("fn"),
        F.count("*").alias("n_evaluated"),
    )
    tp, fp, tn, fn, n = (F.col(c) for c in ("tp", "fp", "tn", "fn", "n_evaluated"))
    known = n > 0
    with_rates = counts.select(
        "*",
        F.when(known, safe_divide(tp + tn, n)).alias("accuracy"),
        F.when(known, safe_divide(tp, tp + fp)).alias("precision"),
        F.when(known, safe_divide(tp, tp + fn)).alias("sensitivity"),
        F.when(known, safe_divide(tn, tn + fp)).alias("specificity"),
        (tp + fn).alias("n_positive"),
        (tn + fp).alias("n_negative"),
    )
    p, r = F.col("precision"), F.col("sensitivity")
    return with_rates.withColumn("f1", F.when(F.col("n_evaluated") > 0, safe_divide(2.0 * p * r, p + r)))


def auroc(frame: DataFrame, measured: tuple[int, dict[str, Ranges]] | None = None) -> DataFrame:
    """Rank-sum area under the ROC curve from per-score class counts; 0.5 when a class is absent."""
    per_score = frame.groupBy("y_hat").agg(
        F.count_if(F.col("y") >= 0.5).alias("pos"), F.count_if(F.col("y") < 0.5).alias("neg")
    )
    n, ranges = measured or measure_ranges(frame, ["y_hat"])
    upto = prefix_sums(per_score, "y_hat", {"neg_upto": "neg"}, ranges["y_hat"])
    won = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2.0)
    sums = upto.agg(F.sum(won).alias("u"), F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("q"))
    area = safe_divide(F.col("u"), F.col("p") * F.col("q"), 0.5)
    return sums.select((area if n else F.lit(None).cast("double")).alias("auroc"))


def auprc(
    frame: DataFrame, keys: list[str], measured: tuple[int, dict[str, Ranges]] | None = None, tie_rows: int = TIE_ROWS
) -> DataFrame:
    """Step-wise area under the precision-recall curve; 0 without positives.

    Rows are visited by descending score, equal scores in the order of their key digests. What precedes a score is a
    running total over the distinct scores. A score shared by more than ``tie_rows`` rows is dealt by leading digits of
    the digests, as many levels of 256 pieces as its number of rows asks for.
    """
    n, ranges = measured or measure_ranges(frame, ["y_hat"])
    rows = frame.select("y_hat", F.when(F.col("y") >= 0.5, 1).otherwise(0).alias("pos"), seeded_digest(0, *keys).alias("h"))
    scores = rows.groupBy("y_hat").agg(F.sum("pos").alias("_p"), F.count("*").alias("_m"))
    upto = prefix_sums(scores, "y_hat", {"_tp": "_p", "_at": "_m"}, ranges["y_hat"], descending=True)
    before = upto.select("y_hat", (F.col("_tp") - F.col("_p")).alias("tp0"), (F.col("_at") - F.col("_m")).alias("at0"))
    ties, pieces = (scores.agg(F.max("_m")).first()[0] or 0) if n > tie_rows else 0, []
    while ties > tie_rows:
        pieces.append(f"_s{len(pieces)}")
        ties //= 256
    if pieces:
        many = cut_lineage(scores.where(F.col("_m") > tie_rows).select("y_hat", F.lit(True).alias("_many")))
        rows = rows.join(many, "y_hat", "left")
        for k, name in enumerate(pieces):
            rows = rows.withColumn(name, F.when(F.col("_many"), digest_number(F.col("h"), 1 + TIE_DIGITS * k, TIE_DIGITS)).otherwise(F.lit(0)).cast("int"))
        rows = rows.drop("_many")
    place = ["y_hat", *pieces]
    inside = W.partitionBy(*place).orderBy("h").rowsBetween(W.unboundedPreceding, 0)
    local = rows.select(*place, "pos", F.sum("pos").over(inside).alias("tp"), F.count("*").over(inside).alias("at"))
    if pieces:  # rows meet their piece, never a whole frequent score
        totals = rows.groupBy(*place).agg(F.sum("pos").alias("_t_tp"), F.count("*").alias("_t_at"))
        before = pieces_before(cut_lineage(totals), pieces).join(before, "y_hat").select(
            *place, (F.col("tp0") + F.col("_o_tp")).alias("tp0"), (F.col("at0") + F.col("_o_at")).alias("at0"))
    precision = (F.col("tp") + F.col("tp0")).cast("double") / (F.col("at") + F.col("at0"))
    sums = local.join(before, place).agg(
        F.sum(F.when(F.col("pos") == 1, precision)).alias("area"), F.sum("pos").cast("double").alias("p")
    )
    value = F.when(F.col("p") > 0, F.col("area") / F.greatest("p", F.lit(1.0))).otherwise(F.lit(0.0))
    return sums.select((value if n else F.lit(None).cast("double")).alias("auprc"))


def pieces_before(totals: DataFrame, pieces: list[str]) -> DataFrame:
    """What precedes a piece of a score within that score: all levels below the score itself."""
    found = totals.select("y_hat", *pieces)
    for depth, level in enumerate(pieces):
        own = ["y_hat", *pieces[: depth + 1]]
        at = totals.groupBy(*own).agg(F.sum("_t_tp").alias("_t_tp"), F.sum("_t_at").alias("_t_at"))
        before = W.partitionBy(*own[:-1]).orderBy(level).rowsBetween(W.unboundedPreceding, -1)
        found = found.join(at.select(*own, *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_p{depth}_{o}") for o in ("tp", "at")]), own)
    add = lambda o: sum((F.col(f"_p{d}_{o}") for d in range(1, len(pieces))), F.col(f"_p0_{o}")).alias(f"_o_{o}")
    return found.select("y_hat", *pieces, add("tp"), add("at"))


def evaluate_binary(frame: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """One row with all binary metrics; they are NULL without valid rows."""
    valid = cut_lineage(finite_pairs(frame).select("y", "y_hat", *keys))
    measured = measure_ranges(valid, ["y_hat"])
    return confusion(valid, threshold).select(
        auroc(valid, measured).scalar().alias("auroc"),
        auprc(valid, keys, measured).scalar().alias("auprc"),
        "f1", "accuracy", "sensitivity", "specificity", "precision",
        F.lit(float(threshold)).alias("threshold"),
        "n_evaluated", "n_positive", "n_negative",
    )
