"""Column functions that several operators share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """True where ``x`` is a finite number; false for null, NaN and infinities."""
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def number(x: Column) -> Column:
    """``x`` as a double, with NaN and what can't be read as null."""
    return F.nanvl(x.try_cast("double"), F.lit(None))


def day(x: Column) -> Column:
    """``x`` as a date, with what can't be read as null."""
    return x.try_cast("date")


def all_true(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_true(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def complete(columns: Sequence[str]) -> Column:
    """True where none of ``columns`` is null."""
    return all_true([F.col(c).isNotNull() for c in columns])


def all_finite(columns: Sequence[str]) -> Column:
    return all_true([finite(F.col(c)) for c in columns])


def close_to(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Equal within tolerance, or both null."""
    return F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), a.isNull() & b.isNull())


def rounded(x: Column, digits: int = 8) -> Column:
    """``x`` rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def qlike(actual: Column, forecast: Column) -> Column:
    """QLIKE loss on variances; null unless both volatilities are positive."""
    ratio = F.try_divide(actual * actual, forecast * forecast)
    return F.when((actual > 0) & (forecast > 0), ratio - F.ln(ratio) - 1.0)


def regime(level: Column, low: Column, high: Column) -> Column:
    """low / middle / high with both bounds included; null level, null regime."""
    return F.when(level <= low, "low").when(level >= high, "high").when(level.isNotNull(), "middle")


def estimate_text(estimate: Column, lower: Column, upper: Column, digits: int = 4) -> Column:
    """'estimate [lower, upper]'."""
    return F.format_string(f"%.{digits}f [%.{digits}f, %.{digits}f]", estimate, lower, upper)
