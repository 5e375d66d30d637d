"""Numeric expressions that stay safe under ANSI mode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def infinity() -> Column:
    return F.lit(INFINITY)


def is_infinite(col: Column) -> Column:
    return F.abs(col) == infinity()


def infinite_to_null(col: Column) -> Column:
    """±infinity and NaN to NULL."""
    return F.when(~(is_infinite(col) | F.isnan(col)), col)


def divide(top: Column, bottom: Column, otherwise: Column | float | None = None) -> Column:
    """``top / bottom``, or ``otherwise`` where the divisor is zero."""
    return F.when(bottom != 0, F.try_divide(top.cast("double"), bottom.cast("double"))).otherwise(
        F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise
    )


def round_half_even(col: Column, digits: int) -> Column:
    """Half-even on the scaled binary value, as numeric array libraries round."""
    scale = float(10**digits)
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def mean_of(cols: list[Column]) -> Column:
    """Row-wise mean over the non-null values; NULL if there is none."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.when(present > 0, total / present)


def largest_name(cols: dict[str, Column]) -> Column:
    """Name of the largest value; the first listed wins a tie, NULLs never win."""
    top = F.greatest(*cols.values()) if len(cols) > 1 else next(iter(cols.values()))
    return F.coalesce(*[F.when(col == top, F.lit(name)) for name, col in cols.items()])
