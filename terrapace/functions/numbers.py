"""Guards against missing and non-finite numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str | float) -> Column:
    """A column by name, a column, or a number as a double literal."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite(x: Column | str | float, default: float, least: float | None = None, strict: bool = False) -> Column:
    """x as a double; the default where it is null, not finite, or below `least` (or equal to it, if strict)."""
    x = col(x).cast("double")
    ok = is_finite(x)
    if least is not None:
        ok &= (x > least) if strict else (x >= least)
    return F.when(ok, x).otherwise(F.lit(float(default)))


def clamp(x: Column, low: float, high: float) -> Column:
    """x within low and high, for an x that is never null (greatest and least pass over nulls)."""
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def clamp_or_null(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), clamp(x, low, high))


def rounded(x: Column | str, digits: int) -> Column:
    """x at so many digits as the SQL engine rounds: halves are judged on the product in binary, not on the decimal text, and go away from zero."""
    return F.round(col(x) * 10.0**digits) / 10.0**digits
