"""One missing value: NULL. NaN and infinity are turned into it where data come in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(value: Column) -> Column:
    """True for finite numbers; false for NULL, NaN, infinities and whatever isn't a number."""
    number = value.try_cast("double")
    return F.coalesce(number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf")), F.lit(False))


def is_positive(value: Column) -> Column:
    return is_finite(value) & (value.try_cast("double") > 0)


def finite_or_null(value: Column) -> Column:
    return F.when(is_finite(value), value.try_cast("double"))


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """a / b as double where b is positive, else `otherwise`."""
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(otherwise).cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    """a / b; 0.0 where b is zero or either side is missing."""
    return F.coalesce(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))), F.lit(0.0))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
