"""New and returning customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bazaarlens.functions import dates
from bazaarlens.functions.numbers import positive_ratio, ratio
from bazaarlens.operators import hypothesis
from bazaarlens.operators.concentration import concentration
from bazaarlens.operators.months import keep_complete
from bazaarlens.plans.growth import category_revenue
from bazaarlens.plans.model import Model


def customer_summary(model: Model) -> DataFrame:
    return (
        model.order_base.where(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg(
            F.count(F.lit(1)).alias("customer_orders"),
            F.sum("order_revenue").alias("customer_revenue"),
            F.avg("order_revenue").alias("avg_order_value"),
            F.min("order_purchase_timestamp").alias("first_purchase"),
        )
        .withColumn("has_repurchase", F.col("customer_orders") > 1)
    )


def repurchase_kpis(model: Model) -> DataFrame:
    """One row of customer base figures."""
    again = F.col("has_repurchase")
    return customer_summary(model).agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.avg("customer_orders").alias("avg_orders_per_customer"),
        (F.avg(again.cast("double")) * 100).alias("pct_customers_with_repurchase"),
        F.coalesce(F.sum(F.when(again, F.col("customer_revenue"))), F.lit(0.0)).alias("revenue_repurchase_customers"),
        F.avg(F.when(again, F.col("avg_order_value"))).alias("avg_ticket_repurchase_customers"),
        F.avg(F.when(~again, F.col("avg_order_value"))).alias("avg_ticket_non_repurchase_customers"),
    )


def ticket_by_repurchase(model: Model) -> DataFrame:
    """Mean customer ticket of returning and one-time customers: two rows."""
    return (
        customer_summary(model)
        .groupBy("has_repurchase")
        .agg(F.count(F.lit(1)).alias("customers"), F.avg("avg_order_value").alias("avg_ticket"))
    )


def monthly_repurchase(model: Model) -> DataFrame:
    """Per delivery month: customers, customers first seen by purchase month,
    returning customers and the mean ticket of both segments.

    A customer-month row counts in its delivery month; the one holding the first
    order also counts as a new customer in the month of that purchase.
    """
    known = F.col("customer_unique_id").isNotNull()
    first = F.col("holds_first_order").cast("long")
    again = F.col("customer_orders") > 1
    facts = ("here", "unique_customers", "repurchase_customers", "new_customers",
             "once_revenue", "once_orders", "again_revenue", "again_orders")

    def event(month, values):
        filled = [values.get(name, F.lit(None)).cast("double").alias(name) for name in facts]
        return F.struct(
            month.alias("month"),
            *filled,
            values.get("first_delivery", F.lit(None)).cast("timestamp_ntz").alias("first_delivery"),
            values.get("last_delivery", F.lit(None)).cast("timestamp_ntz").alias("last_delivery"),
        )

    delivered = event(
        F.col("month"),
        {
            "here": F.lit(1),
            "unique_customers": known.cast("int"),
            "repurchase_customers": (known & (F.col("orders") > first)).cast("int"),
            "once_revenue": F.when(~again, F.col("revenue")),
            "once_orders": F.when(~again, F.col("orders")),
            "again_revenue": F.when(again, F.col("revenue")),
            "again_orders": F.when(again, F.col("orders")),
            "first_delivery": F.col("first_delivery"),
            "last_delivery": F.col("last_delivery"),
        },
    )
    arrived = event(
        dates.month_start(F.col("first_order.order_purchase_timestamp")), {"new_customers": F.lit(1)}
    )
    events = F.when(known & F.col("holds_first_order"), F.array(delivered, arrived)).otherwise(F.array(delivered))
    monthly = (
        model.customer_month.select(F.inline(events))
        .groupBy("month")
        .agg(
            *[F.sum(name).alias(name) for name in facts],
            F.min("first_delivery").alias("first_delivery"),
            F.max("last_delivery").alias("last_delivery"),
        )
        .where(F.col("here") > 0)
    )

    def count(name):
        return F.coalesce(F.col(name), F.lit(0)).cast("long")

    derived = monthly.select(
        "month",
        dates.month_label(F.col("month")).alias("year_month"),
        count("unique_customers").alias("unique_customers"),
        count("new_customers").alias("new_customers"),
        count("repurchase_customers").alias("repurchase_customers"),
        positive_ratio(count("repurchase_customers"), count("unique_customers")).alias("repurchase_customer_rate"),
        ratio(F.col("once_revenue"), F.col("once_orders")).alias("avg_ticket_non_repurchase_customers"),
        ratio(F.col("again_revenue"), F.col("again_orders")).alias("avg_ticket_repurchase_customers"),
        "first_delivery",
        "last_delivery",
    )
    return keep_complete(derived, "month", "first_delivery", "last_delivery", model.settings.start_date)


def repurchase_categories(model: Model) -> DataFrame:
    """Category concentration over the items of returning customers."""
    returning = customer_summary(model).where("has_repurchase").select("customer_unique_id")
    orders = (
        model.delivered.select("order_id", "customer_id")
        .join(model.customers.select("customer_id", "customer_unique_id"), "customer_id")
        .join(returning, "customer_unique_id", "left_semi")
    )
    items = model.delivered_items.join(orders.select("order_id"), "order_id", "left_semi")
    return concentration(category_revenue(model, items), "product_category_final", "item_revenue")


def ticket_welch(model: Model) -> DataFrame:
    return hypothesis.welch(
        customer_summary(model), "avg_order_value", F.col("has_repurchase"), model.settings.small_sample
    )


def ticket_mann_whitney(model: Model) -> DataFrame:
    return hypothesis.mann_whitney(customer_summary(model), "avg_order_value", F.col("has_repurchase"))


def ticket_tests(model: Model) -> DataFrame:
    return hypothesis.two_group_tests(
        customer_summary(model),
        "avg_order_value",
        F.col("has_repurchase"),
        "mean ticket by customer group",
        model.settings.small_sample,
    )
