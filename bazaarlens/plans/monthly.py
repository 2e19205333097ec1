"""Monthly business series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bazaarlens.functions import dates
from bazaarlens.functions.numbers import positive_ratio, ratio
from bazaarlens.operators.months import keep_complete
from bazaarlens.plans.model import Model


def _change(value: str) -> Column:
    """Percent change to the previous row. One row per month: a small window."""
    previous = F.lag(value).over(Window.orderBy("month"))
    return (ratio(F.col(value), previous) - 1) * 100


def monthly_metrics(model: Model) -> DataFrame:
    s = model.settings
    known = F.col("customer_unique_id").isNotNull()
    first = F.col("holds_first_order").cast("long")
    monthly = model.customer_month.groupBy("month").agg(
        F.sum("revenue").alias("revenue_month"),
        F.sum("orders").alias("orders_month"),
        F.count_if(known).alias("unique_customers"),
        F.sum("valid_orders").alias("delivered_orders_valid"),
        F.sum("delayed_orders").alias("delayed_orders"),
        F.sum("delay_sum").alias("delay_sum"),
        F.sum("lead_sum").alias("lead_sum"),
        F.sum("score_sum").alias("score_sum"),
        F.sum("reviewed_orders").alias("review_count"),
        F.sum("negative_orders").alias("negative_orders"),
        F.sum("negative_orders_fallback").alias("negative_orders_fallback"),
        F.count_if(known & F.col("holds_first_order")).alias("new_customers"),
        F.count_if(known & (F.col("orders") > first)).alias("repurchase_customers"),
        F.sum(F.col("orders") - first).alias("repurchase_orders"),
        F.min("first_delivery").alias("first_delivery"),
        F.max("last_delivery").alias("last_delivery"),
    )
    all_negative = F.sum("negative_orders").over(Window.partitionBy())
    negative = F.when(all_negative < s.min_negative_reviews, F.col("negative_orders_fallback")).otherwise(
        F.col("negative_orders")
    )
    derived = monthly.select(
        "month",
        dates.month_label(F.col("month")).alias("year_month"),
        "revenue_month",
        "orders_month",
        ratio(F.col("revenue_month"), F.col("orders_month")).alias("avg_ticket_month"),
        "unique_customers",
        "delivered_orders_valid",
        "delayed_orders",
        ratio(F.col("delay_sum"), F.col("delivered_orders_valid")).alias("avg_delay_days"),
        ratio(F.col("lead_sum"), F.col("delivered_orders_valid")).alias("avg_lead_time_days"),
        ratio(F.col("score_sum"), F.col("review_count")).alias("avg_review_score"),
        ratio(negative, F.col("review_count")).alias("negative_review_rate"),
        F.nullif(F.col("review_count"), F.lit(0)).alias("review_count"),
        "new_customers",
        "repurchase_customers",
        ratio(F.col("repurchase_orders"), F.col("orders_month")).alias("repurchase_order_rate"),
        positive_ratio(F.col("delayed_orders"), F.col("delivered_orders_valid")).alias("late_rate"),
        positive_ratio(F.col("repurchase_customers"), F.col("unique_customers")).alias("repurchase_customer_rate"),
        "first_delivery",
        "last_delivery",
    )
    complete = keep_complete(derived, "month", "first_delivery", "last_delivery", s.start_date)
    return complete.withColumns(
        {
            "revenue_mom_pct": _change("revenue_month"),
            "orders_mom_pct": _change("orders_month"),
            "ticket_mom_pct": _change("avg_ticket_month"),
        }
    )


def monthly_ohlc(model: Model) -> DataFrame:
    """First, highest, lowest and last daily revenue of each complete month."""
    day, value = F.col("purchase_date"), F.col("daily_revenue")
    monthly = (
        model.daily_revenue.where(day.isNotNull() & value.isNotNull())
        .groupBy(dates.month_start(day).alias("month"))
        .agg(
            F.min_by(value, day).alias("open"),
            F.max(value).alias("high"),
            F.min(value).alias("low"),
            F.max_by(value, day).alias("close"),
            F.sum("daily_orders").alias("volume"),
            F.min(day).alias("first_day"),
            F.max(day).alias("last_day"),
        )
    )
    complete = keep_complete(monthly, "month", "first_day", "last_day", model.settings.start_date)
    return complete.select(
        "month", dates.month_label(F.col("month")).alias("label"), "open", "high", "low", "close", "volume"
    )
