"""Null-safe arithmetic; a missing value is NULL, never NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-12


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def number(c: Column | str) -> Column:
    """Text or number to a finite double, anything else to NULL."""
    return finite(col(c).try_cast("double"))


def safe_divide(n: Column | str, d: Column | str) -> Column:
    n, d = col(n), col(d)
    return F.when(F.abs(d) >= TINY, n / d)


def scale_0_1(value: Column | str, low: float, high: float) -> Column:
    return clip((col(value) - low) / (high - low), 0.0, 1.0)


def clip(value: Column | str, low: float, high: float) -> Column:
    """Bound a value; NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    value = col(value)
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def population_cv(values: Column | str) -> Column:
    """Aggregate: population standard deviation over mean, NULL near a zero mean."""
    return safe_divide(F.stddev_pop(col(values)), F.avg(col(values)))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Aggregate: weighted mean over rows with a value and a positive weight."""
    value, weight = number(value), number(weight)
    use = value.isNotNull() & (weight > 0)
    return safe_divide(F.sum(F.when(use, value * weight)), F.sum(F.when(use, weight)))


def log_base(value: Column | str, base: float) -> Column:
    return F.when(col(value) > 0, F.log(col(value)) / F.log(F.lit(float(base))))


def round_half_even(value: Column | str) -> Column:
    return F.bround(col(value), 0)


def sides(width: int | Column, height: int | Column) -> tuple[Column, Column]:
    """Image sides as columns; plain numbers are allowed."""
    return tuple(F.lit(v) if isinstance(v, int) else v for v in (width, height))


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add expensive columns through a one-row generator.

    Later filters on the new columns stay above the generator, so the expressions are
    evaluated once per row and are not copied into every expression that uses them.
    """
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(packed)))
