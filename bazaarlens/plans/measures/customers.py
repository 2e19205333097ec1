"""Customer and product page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from bazaarlens.functions import dates
from bazaarlens.functions.numbers import ratio, relative_change
from bazaarlens.plans.measures.semantic import PRODUCT_SIDE, Conditions, Semantic, visible, without_filters

By = Sequence[str]


def unique_customers(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    """Distinct customers with orders in context."""
    rows = s.scope(by, where, where_items, need=["customer_unique_id"])
    pairs = rows.where(F.col("customer_unique_id").isNotNull()).select(*by, "customer_unique_id").distinct()
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("unique_customers"))


def purchase_frequency(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    """Mean distinct orders per customer that has any."""
    rows = s.scope(by, where, where_items, need=["customer_unique_id"])
    per_customer = rows.groupBy(*by, "customer_unique_id").agg(F.count(F.lit(1)).alias("_orders"))
    return per_customer.groupBy(*by).agg(F.avg("_orders").alias("purchase_frequency"))


def new_customers(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    """Customers whose first purchase, the calendar filter removed, falls in the
    month (M31). ``by`` holds attributes besides the month; they stay filters on
    the search for the first purchase."""
    by = [name for name in by if name != "year_month"]
    rows = s.scope(by, where, where_items, need=["customer_unique_id"])
    first = rows.where(F.col("customer_unique_id").isNotNull()).groupBy(*by, "customer_unique_id").agg(
        F.min("order_purchase_timestamp").alias("_first")
    )
    month = dates.month_label(F.col("_first")).alias("year_month")
    return first.where(F.col("_first").isNotNull()).groupBy(month, *by).agg(F.count(F.lit(1)).alias("new_customers"))


def _returning_pairs(s: Semantic, by: By, where: Conditions, where_items: Conditions) -> DataFrame:
    """(month, by, customer) pairs with an order with items in the month, flagged
    when the customer had any order before that month: filters on products are
    removed for it, those on sellers and customers stay."""
    product_free = [name for name in by if name not in (*PRODUCT_SIDE, "year_month")]
    here = s.scope(
        ["year_month", *[n for n in by if n != "year_month"]], where, where_items,
        need=["customer_unique_id"], with_items=True,
    ).where(F.col("customer_unique_id").isNotNull() & F.col("date_purchase").isNotNull())
    names = [n for n in by if n != "year_month"]
    pairs = here.select("year_month", *names, "customer_unique_id").distinct()
    earlier = s.scope(product_free, where, without_filters(where_items, PRODUCT_SIDE), need=["customer_unique_id"])
    first = earlier.groupBy(
        F.col("customer_unique_id").alias("_customer"), *[F.col(n).alias(f"_{n}") for n in product_free]
    ).agg(dates.month_label(F.min("date_purchase")).alias("_first_month"))
    match = F.col("customer_unique_id") == F.col("_customer")
    for name in product_free:
        match = match & F.col(name).eqNullSafe(F.col(f"_{name}"))
    return pairs.join(first, match, "left").select(
        "year_month", *names, "customer_unique_id", (F.col("_first_month") < F.col("year_month")).alias("_returning")
    )


def returning_customers(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    """Per month: customers that bought in it, inside the context, and already had
    an order before it; product filters do not narrow the earlier order (M30)."""
    names = [n for n in by if n != "year_month"]
    counted = _returning_pairs(s, by, where, where_items).groupBy("year_month", *names).agg(
        F.count_if("_returning").alias("returning_customers")
    )
    return counted.where(F.col("returning_customers") > 0)


def returning_share(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    """Returning customers over unique customers of the month."""
    names = ["year_month", *[n for n in by if n != "year_month"]]
    returning = returning_customers(s, by, where, where_items)
    unique = unique_customers(s, names, where, where_items)
    return returning.join(unique, names).select(
        *names, ratio(F.col("returning_customers"), F.col("unique_customers")).alias("returning_share")
    )


def items_of_recurring_customers(
    s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None
) -> DataFrame:
    """Items of customers with two or more orders in context, product filters
    removed for that test (M35)."""
    product_free = [name for name in by if name not in PRODUCT_SIDE]
    tested = s.scope(
        product_free, where, without_filters(where_items, PRODUCT_SIDE), need=["customer_unique_id"], with_items=True
    )
    keys = [*product_free, "customer_unique_id"]
    recurring = tested.where(F.col("customer_unique_id").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_orders")
    )
    recurring = recurring.where(F.col("_orders") >= 2).select(*[F.col(k).alias(f"_{k}") for k in keys])
    sold = s.scope(by, where, where_items, need=["customer_unique_id"], with_items=True)
    sold = sold.groupBy(*by, *[k for k in keys if k not in by]).agg(F.sum("items").alias("_items"))
    match = F.col("customer_unique_id") == F.col("_customer_unique_id")
    for name in product_free:
        match = match & F.col(name).eqNullSafe(F.col(f"_{name}"))
    kept = sold.join(recurring, match, "left_semi")
    return kept.groupBy(*by).agg(F.sum("_items").alias("items_of_recurring_customers"))


# ------------------------------------------------------------------- trends
def trailing_revenue(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    """Per calendar month end: revenue of the three months up to it (M37), of the
    three before those (M36) and the change (M38).

    Windows start one day after the same day three months earlier. A day can only
    fall in the windows of the seven month ends after it, so each daily sum is
    sent to those: no range join. ``by`` holds attributes besides the month."""
    daily = s.scope([*by], where, where_items, with_items=True).groupBy("date_purchase", *by).agg(
        F.sum("revenue").alias("_revenue")
    )
    day, ref = F.col("date_purchase"), F.col("_ref")
    refs = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.last_day(F.add_months(F.trunc(day, "MM"), k)))
    spread = daily.where(day.isNotNull()).select(*by, "date_purchase", "_revenue", F.explode(refs).alias("_ref"))
    in_last = (day > F.add_months(ref, -3)) & (day <= ref)
    in_previous = (day > F.add_months(ref, -6)) & (day <= F.add_months(ref, -3))
    last_end = s.months.agg(F.max("month_end")).scalar()
    windows = (
        spread.where((in_last | in_previous) & (ref <= last_end))
        .groupBy("_ref", *by)
        .agg(
            F.sum(F.when(in_last, F.col("_revenue"))).alias("revenue_last_3_months"),
            F.sum(F.when(in_previous, F.col("_revenue"))).alias("revenue_previous_3_months"),
        )
    )
    return windows.select(
        dates.month_label(ref).alias("year_month"),
        *by,
        "revenue_last_3_months",
        "revenue_previous_3_months",
        relative_change(F.col("revenue_last_3_months"), F.col("revenue_previous_3_months")).alias("revenue_trend"),
    )


def trailing_measure(column: str):
    def measure(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
        return visible(trailing_revenue(s, by, where, where_items).select("year_month", *by, column), column)

    measure.__name__ = column
    return measure


revenue_previous_3_months = trailing_measure("revenue_previous_3_months")  # M36
revenue_last_3_months = trailing_measure("revenue_last_3_months")  # M37
revenue_trend = trailing_measure("revenue_trend")  # M38
