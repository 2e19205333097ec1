"""Calendar arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def month_start(value: Column) -> Column:
    return F.trunc(value, "MM")


def month_end(value: Column, months: int = 0) -> Column:
    """Last day of the month ``months`` away."""
    return F.last_day(F.add_months(F.trunc(value, "MM"), months))


def month_label(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM")


def elapsed_days(start: Column, end: Column) -> Column:
    """Fractional days between two timestamps."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(86400e6)


def day_boundaries(start: Column, end: Column) -> Column:
    """Whole days between two dates, counting midnights crossed."""
    return F.datediff(F.to_date(end), F.to_date(start))


def month_boundaries(start: Column, end: Column) -> Column:
    """Whole months between two dates, counting month starts crossed."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def weekday_monday_first(value: Column) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return F.weekday(value) + 1


def week_of_year(value: Column) -> Column:
    """Weeks start on Monday and week 1 holds 1 January (not the ISO week)."""
    offset = F.weekday(F.trunc(value, "YEAR"))
    return F.floor((F.dayofyear(value) - 1 + offset) / 7).cast("int") + 1
