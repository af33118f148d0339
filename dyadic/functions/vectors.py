"""Array algebra inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from dyadic.functions.numeric import FLOOR, clip


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(left: Column | str, right: Column | str) -> Column:
    return total(F.zip_with(_col(left), _col(right), lambda x, y: x * y))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    An outer column used inside a higher-order lambda is inlined by the optimizer and then evaluated for
    every element; binding it as a lambda variable keeps it to one evaluation.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(vector: Column | str) -> Column:
    """Vector divided by its L2 norm; zero vectors stay zero."""
    return let(
        _col(vector),
        lambda v: let(F.greatest(norm(v), F.lit(FLOOR)), lambda n: F.transform(v, lambda x: x / n)),
    )


def shifted_cosine(left_unit: Column | str, right_unit: Column | str) -> Column:
    """``(cos + 1) / 2`` of two unit vectors, clipped to [0, 1]."""
    return clip((dot(left_unit, right_unit) + 1.0) * 0.5, 0.0, 1.0)


def sparse_dot(left: Column | str, right: Column | str) -> Column:
    """Dot product of two ``map<int,double>`` vectors."""
    left, right = _col(left), _col(right)
    return F.aggregate(
        F.map_entries(left),
        F.lit(0.0),
        lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(right, e["key"]), F.lit(0.0)),
    )


def matrix_times(rows: Column, vector: Column | str) -> Column:
    """Product of an ``array<array<double>>`` with a vector."""
    vector = _col(vector)
    return F.transform(rows, lambda row: dot(row, vector))


def masked_mean(vectors: Column | str, mask: Column | str, width: int) -> Column:
    """Mean of the vectors whose mask entry is set; the count is floored at 1e-8."""
    vectors, mask = _col(vectors), _col(mask)
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m.cast("double")), F.lit(1e-8))
    weighted = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x * m))
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.aggregate(weighted, F.lit(0.0), lambda acc, v: acc + F.get(v, i)) / count,
    )
