"""Ratios and blank-aware arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``; null when the denominator is zero or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def positive_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio that is only defined for a denominator above zero."""
    return F.when(denominator > 0, ratio(numerator, denominator))


def blank_minus(left: Column, right: Column) -> Column:
    """Dashboard subtraction: a blank counts as zero, two blanks stay blank."""
    zero = F.lit(0.0)
    both_blank = left.isNull() & right.isNull()
    return F.when(~both_blank, F.coalesce(left, zero) - F.coalesce(right, zero))


def relative_change(current: Column, previous: Column) -> Column:
    """``(current - previous) / previous`` with dashboard blank rules."""
    return ratio(blank_minus(current, previous), previous)


def clip_low(value: Column, low: float = 0.0) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), value))


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(value.isNotNull(), F.least(high, F.greatest(low, value)))


def finite(value: Column) -> Column:
    """NaN and infinities become null."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)
