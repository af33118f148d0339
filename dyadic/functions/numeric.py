"""Scalar expressions on numbers: coercion, clipping, guarded division, squashing, binarisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def coerce_number(text: Column | str) -> Column:
    """Numeric value of a string, NULL when it does not parse or is NaN."""
    return F.nullif(_col(text).try_cast("double"), F.lit(float("nan")))


def is_finite(value: Column | str) -> Column:
    value = _col(value)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def clip(value: Column, low: float, high: float) -> Column:
    """``value`` kept within bounds; NULL stays NULL."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))


def safe_divide(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """Quotient, or ``default`` when the denominator is nearly zero."""
    return F.when(F.abs(denominator) < FLOOR, F.lit(float(default))).otherwise(
        numerator.cast("double") / denominator
    )


def sigmoid(value: Column, bound: float = 50.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(value, -bound, bound)))


def affinity_label(value: Column | str, threshold: float = 7.6) -> Column:
    """Binary label of an affinity in nM.

    Values up to 1 are taken as labels already and truncated to an integer. Larger values become
    ``-log10(v * 1e-9 + 1e-10)`` and the label is 1 when that does not exceed the threshold, so the
    *weaker* pairs carry the 1.
    """
    value = _col(value)
    strength = -F.log10(value * F.lit(1e-9) + F.lit(1e-10))
    return F.when(value <= 1.0, value.cast("int")).otherwise((strength <= threshold).cast("int"))


def bounded_score(loss: Column) -> Column:
    """``1 / (1 + loss)`` with negative losses read as zero."""
    return F.lit(1.0) / (F.lit(1.0) + F.greatest(loss, F.lit(0.0)))
