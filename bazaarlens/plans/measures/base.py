"""Revenue, orders, tickets and delivery-dated growth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from bazaarlens.functions import dates
from bazaarlens.functions.numbers import ratio, relative_change
from bazaarlens.plans.measures.semantic import Conditions, Semantic, visible

By = Sequence[str]


def orders(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    """Distinct orders."""
    return s.scope(by, where, where_items).groupBy(*by).agg(F.count(F.lit(1)).alias("orders"))


def delivered_orders(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    """Distinct delivered orders (M55); rows without any are blank, hence absent."""
    counted = s.scope(by, where, where_items).groupBy(*by).agg(F.count_if("is_delivered").alias("delivered_orders"))
    return counted.where(F.col("delivered_orders") > 0)


def product_revenue(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    """Sum of item prices."""
    rows = s.scope(by, where, where_items, with_items=True)
    return rows.groupBy(*by).agg(F.sum("revenue").alias("product_revenue"))


def items_sold(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    """Item rows."""
    rows = s.scope(by, where, where_items, with_items=True)
    return rows.groupBy(*by).agg(F.sum("items").alias("items_sold"))


def average_ticket(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    """Revenue per order (M06). Orders without items count in the denominator."""
    facts = s.scope(by, where, where_items).groupBy(*by).agg(
        F.sum("revenue").alias("_revenue"), F.count(F.lit(1)).alias("_orders")
    )
    return facts.select(*by, ratio(F.col("_revenue"), F.col("_orders")).alias("average_ticket"))


def average_installments(
    s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None
) -> DataFrame:
    """Mean over orders of the largest instalment count."""
    largest = (
        s.model.tables["order_payments"]
        .where(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(F.max("payment_installments").alias("_installments"))
    )
    rows = s.scope(by, where, where_items).join(largest, "order_id")
    return rows.groupBy(*by).agg(F.avg("_installments").alias("average_installments"))


def revenue_by_delivery(
    s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None, delivered_only: bool = True
) -> DataFrame:
    """Revenue dated by delivery (M04): ``year_month`` is the delivery month.
    ``delivered_only`` False gives the variant without the status filter."""
    rows = s.with_role("delivered").scope(by, where, where_items, with_items=True)
    rows = rows.where(F.col("date_delivered").isNotNull())
    if delivered_only:
        rows = rows.where("is_delivered")
    return rows.groupBy(*by).agg(F.sum("revenue").alias("revenue_by_delivery"))


def card_growth(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    """Delivery-dated revenue of each calendar month seen as the last visible one
    (M05), of the month before it (M58) and the change between them (M01).

    Each revenue month is placed in its own row and in the next month's row, so
    no self-join is needed. ``by`` holds further attributes besides the month."""
    revenue = revenue_by_delivery(s, ["year_month", *by], where, where_items)
    start = F.to_date(F.concat("year_month", F.lit("-01")))
    value, none = F.col("revenue_by_delivery"), F.lit(None).cast("double")
    placed = F.array(
        F.struct(start.alias("month_start"), value.alias("last"), none.alias("previous")),
        F.struct(F.add_months(start, 1).alias("month_start"), none.alias("last"), value.alias("previous")),
    )
    months = s.months.agg(F.max("month_start")).scalar()
    cards = (
        revenue.select(*by, F.inline(placed))
        .groupBy("month_start", *by)
        .agg(F.sum("last").alias("revenue_last_month"), F.sum("previous").alias("revenue_previous_month"))
        .where(F.col("month_start") <= months)
    )
    return cards.select(
        dates.month_label(F.col("month_start")).alias("year_month"),
        *by,
        "revenue_last_month",
        "revenue_previous_month",
        relative_change(F.col("revenue_last_month"), F.col("revenue_previous_month")).alias("revenue_growth"),
    )


def revenue_last_month(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    cards = card_growth(s, by, where, where_items).select("year_month", *by, "revenue_last_month")
    return visible(cards, "revenue_last_month")


def revenue_previous_month(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    cards = card_growth(s, by, where, where_items).select("year_month", *by, "revenue_previous_month")
    return visible(cards, "revenue_previous_month")


def revenue_growth_card(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    return visible(card_growth(s, by, where, where_items).select("year_month", *by, "revenue_growth"), "revenue_growth")
