"""Dashboard calendar and what-if parameter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bazaarlens.functions import dates
from bazaarlens.settings import Settings

# Brazilian month and weekday names (January and Monday first).
MONTHS_PT = (
    "janeiro", "fevereiro", "março", "abril", "maio", "junho",
    "julho", "agosto", "setembro", "outubro", "novembro", "dezembro",
)
WEEKDAYS_PT = (
    "segunda-feira", "terça-feira", "quarta-feira", "quinta-feira", "sexta-feira", "sábado", "domingo",
)

# Largest setting of each what-if slider, in percent.
MAX_LATE_REDUCTION = 30
MAX_REPURCHASE_INCREASE = 20
MAX_SELLER_EXPANSION = 20


def calendar_days(orders: DataFrame, settings: Settings) -> DataFrame:
    """One row per date from the fixed start to the end of the month six months
    after the last purchase. Bounded by the years covered, not by the orders."""
    last = F.to_date(F.max("order_purchase_timestamp"))
    end = dates.month_end(last, settings.calendar_months_ahead)
    span = orders.agg(F.sequence(F.lit(settings.calendar_start), end).alias("days"))
    return span.select(F.explode("days").alias("date"))


def calendar(orders: DataFrame, settings: Settings, locale: str = "en") -> DataFrame:
    day = F.col("date")
    if locale == "pt":
        month_name = F.element_at(F.array(*map(F.lit, MONTHS_PT)), F.month(day))
        month_short = F.substring(month_name, 1, 3)
        weekday_name = F.element_at(F.array(*map(F.lit, WEEKDAYS_PT)), dates.weekday_monday_first(day))
    else:
        month_name = F.date_format(day, "MMMM")
        month_short = F.date_format(day, "MMM")
        weekday_name = F.date_format(day, "EEEE")
    return calendar_days(orders, settings).select(
        "date",
        F.date_format(day, "yyyy-MM-dd").alias("date_id"),
        F.year(day).alias("year"),
        F.month(day).alias("month_number"),
        month_name.alias("month_name"),
        month_short.alias("month_short"),
        dates.month_label(day).alias("year_month"),
        (F.year(day) * 100 + F.month(day)).alias("year_month_order"),
        F.concat(F.lit("T"), F.quarter(day).cast("string")).alias("quarter"),
        dates.weekday_monday_first(day).alias("weekday_number"),
        weekday_name.alias("weekday_name"),
        dates.week_of_year(day).alias("week_of_year"),
    )


def parameter_series(spark: SparkSession, name: str, last: int) -> DataFrame:
    return spark.range(0, last + 1).select(F.col("id").cast("int").alias(name))
