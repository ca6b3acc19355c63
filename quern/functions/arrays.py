"""Array-column expressions: element-wise arithmetic, products and norms, all inside Spark's own operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return total(F.zip_with(a, b, lambda u, v: u * v))


def sqdist(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, from differences."""
    return total(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)))


def absdist(a: Column, b: Column) -> Column:
    """Manhattan distance."""
    return total(F.zip_with(a, b, lambda u, v: F.abs(u - v)))


def norm(x: Column, kind: str = "l2") -> Column:
    """l1, l2 or max norm."""
    if kind == "l2":
        return F.sqrt(total(F.transform(x, lambda v: v * v)))
    size = F.transform(x, F.abs)
    return total(size) if kind == "l1" else F.coalesce(F.array_max(size), F.lit(0.0))


def or_one(x: Column) -> Column:
    """A divisor: one where x is zero."""
    return F.when(x == 0, 1.0).otherwise(x)


def literal(values: Sequence[float]) -> Column:
    """A constant array of doubles."""
    return F.array(*[F.lit(float(v)) for v in values])


def first_argmax(x: Column) -> Column:
    """0-based place of the first largest element."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def doubles(*names: str) -> Column:
    """A features array from numeric columns."""
    return F.array(*[F.col(n).cast("double") for n in names])
