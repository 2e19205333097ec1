"""Complete-month rules on monthly tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from bazaarlens.functions import dates


def complete_bounds(first: Column, last: Column, forced_start: dt.date) -> Column:
    """Struct (start, end, dropped) of the complete months between two timestamps.

    A first month that does not begin on day 1 and a last month that does not
    reach its final day are left out, unless nothing would remain. A start later
    than the month of ``forced_start`` is moved back to it.
    """
    first_month, last_month = F.trunc(first, "MM"), F.trunc(last, "MM")
    forced = F.lit(forced_start.replace(day=1))
    cut_first = F.day(first) != 1
    cut_last = F.to_date(last) != F.last_day(last)
    start = F.when(cut_first, F.add_months(first_month, 1)).otherwise(first_month)
    end = F.when(cut_last, F.add_months(last_month, -1)).otherwise(last_month)
    emptied = start > end
    start = F.when(emptied, first_month).otherwise(start)
    end = F.when(emptied, last_month).otherwise(end)
    moved = start > forced
    dropped = F.array(
        F.when(cut_first & ~emptied, dates.month_label(first_month)),
        F.when(cut_last & ~emptied, dates.month_label(last_month)),
    )
    dropped = F.filter(
        dropped, lambda label: label.isNotNull() & ~(moved & (label == F.lit(forced_start.strftime("%Y-%m"))))
    )
    return F.when(
        first.isNotNull(),
        F.struct(
            F.when(moved, forced).otherwise(start).alias("start"),
            end.alias("end"),
            dropped.alias("dropped"),
        ),
    )


def keep_complete(monthly: DataFrame, month: str, first: str, last: str, forced_start: dt.date) -> DataFrame:
    """Keep the complete months of a monthly table that carries its own first and
    last timestamps. One row per month, so the unpartitioned window is small."""
    every = Window.partitionBy()
    bounds = complete_bounds(F.min(first).over(every), F.max(last).over(every), forced_start)
    marked = monthly.withColumn("_bounds", bounds)
    inside = F.col(month).between(F.col("_bounds.start"), F.col("_bounds.end"))
    return marked.where(F.col("_bounds").isNull() | inside).drop("_bounds", first, last)
