"""The dashboard's star: orders in the middle, everything else filters them.

A measure is a function of (semantic, by, where, where_items). ``by`` names the
attributes of the result rows, ``where`` holds SQL conditions on order, customer and
calendar attributes and ``where_items`` ones on item, product and seller attributes:
one condition or a list of them. Conditions belong to the tables whose attributes
they name, so that a measure can remove the filters of one table and keep the rest.

Filters travel along the relations: customers and the calendar reach orders by
their keys, products and sellers reach items, and items reach orders through the
distinct (order, attribute) pairs of the item table.

The calendar's date is the purchase date (the active link) unless another role is
asked for; ``year_month`` and all calendar attributes follow the role.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from bazaarlens.functions import dates, text
from bazaarlens.operators.ordering import running_totals
from bazaarlens.plans.model import Model
from bazaarlens.sources.calendar import calendar, calendar_days

DATE_ROLES = {
    "purchase": "order_purchase_timestamp",
    "approved": "order_approved_at",
    "carrier": "order_delivered_carrier_date",
    "delivered": "order_delivered_customer_date",
    "estimated": "order_estimated_delivery_date",
}
CUSTOMER_ATTRIBUTES = ("customer_unique_id", "customer_city", "customer_state", "map_location")
PRODUCT_ATTRIBUTES = ("product_category_name",)
SELLER_ATTRIBUTES = ("seller_city", "seller_state", "seller_alias")
CALENDAR_ATTRIBUTES = (
    "date", "date_id", "year", "quarter", "month_number", "month_name", "month_short", "year_month_order",
    "weekday_number", "weekday_name", "week_of_year",
)
ITEM_ATTRIBUTES = ("seller_id", "product_id", *PRODUCT_ATTRIBUTES, *SELLER_ATTRIBUTES)
# Attributes a "remove seller filters" clause ignores.
SELLER_SIDE = ("seller_id", *SELLER_ATTRIBUTES)
PRODUCT_SIDE = ("product_id", *PRODUCT_ATTRIBUTES)
ALIAS_DIGITS = 3

Conditions = str | Sequence[str] | None


def listed(conditions: Conditions) -> list[str]:
    return [] if not conditions else [conditions] if isinstance(conditions, str) else list(conditions)


def mentioned(conditions: Conditions, names: Sequence[str]) -> list[str]:
    """The ones of ``names`` that some condition uses; quoted text does not count."""
    bare = " ".join(re.sub(r"'[^']*'", "''", c) for c in listed(conditions))
    return [name for name in names if re.search(rf"\b{name}\b", bare)]


def without_filters(conditions: Conditions, removed: Sequence[str]) -> list[str]:
    """The conditions left when the filters on the ``removed`` attributes go.

    A condition that ties removed attributes to others has no meaning then."""
    kept = []
    for condition in listed(conditions):
        if not mentioned(condition, removed):
            kept.append(condition)
        elif others := mentioned(condition, [name for name in ITEM_ATTRIBUTES if name not in removed]):
            raise ValueError(f"filters on {others} are kept here: state them apart from '{condition}'")
    return kept


class Semantic:
    def __init__(self, model: Model, date_role: str = "purchase"):
        self.model = model
        self.settings = model.settings
        self.date_role = date_role

    def with_role(self, date_role: str) -> "Semantic":
        return Semantic(self.model, date_role)

    @property
    def spark(self):
        return self.model.spark

    # ------------------------------------------------------------ base tables
    @cached_property
    def orders(self) -> DataFrame:
        """All orders with truncated date keys, delivery classes and folded reviews."""
        orders = self.model.tables["orders"]
        keys = {
            f"date_{role}": F.to_date(F.col(name) if name in orders.columns else F.lit(None).cast("timestamp_ntz"))
            for role, name in DATE_ROLES.items()
        }
        delivered = F.coalesce(F.col("order_status") == "delivered", F.lit(False))
        timed = delivered & F.col("date_delivered").isNotNull() & F.col("date_estimated").isNotNull()
        late = F.col("date_delivered") > F.col("date_estimated")
        days_late = F.greatest(F.lit(0), F.datediff("date_delivered", "date_estimated"))
        return (
            orders.select("order_id", "customer_id", "order_status", "order_purchase_timestamp",
                          *[value.alias(name) for name, value in keys.items()])
            .withColumns(
                {
                    "is_delivered": delivered,
                    "is_late": timed & late,
                    "is_on_time": timed & ~late,
                    "days_late": F.when(
                        F.col("date_delivered").isNotNull() & F.col("date_estimated").isNotNull(), days_late
                    ),
                    "year_month": dates.month_label(F.col(f"date_{self.date_role}")),
                }
            )
            .join(self.review_facts, "order_id", "left")
        )

    @cached_property
    def review_facts(self) -> DataFrame:
        """Per order: mean score, number of review rows, lowest score."""
        reviews = self.model.tables["order_reviews"].where(F.col("order_id").isNotNull())
        return reviews.groupBy("order_id").agg(
            F.avg("review_score").alias("order_score"),
            F.count(F.lit(1)).alias("reviews"),
            F.min("review_score").alias("lowest_score"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        customers = self.model.tables["customers"]
        return customers.select(
            "customer_id",
            "customer_unique_id",
            "customer_city",
            "customer_state",
            map_location(customers).alias("map_location"),
        )

    @cached_property
    def seller_aliases(self) -> DataFrame:
        """Anonymous name per seller: its dense rank by id."""
        sellers = self.model.tables["sellers"].where(F.col("seller_id").isNotNull()).select("seller_id").distinct()
        numbered = running_totals(sellers, [F.col("seller_id").asc()])
        alias = F.concat(F.lit("Seller #"), text.zero_padded(F.col("position"), ALIAS_DIGITS))
        return numbered.select("seller_id", alias.alias("seller_alias"))

    def items(self, attributes: Sequence[str], where_items: Conditions = None) -> DataFrame:
        """Items folded to (order, attributes): revenue and item rows."""
        items = self.model.tables["order_items"].select("order_id", "product_id", "seller_id", "price")
        named = {*attributes, *mentioned(where_items, ITEM_ATTRIBUTES)}
        if named & set(PRODUCT_ATTRIBUTES):
            items = items.join(
                self.model.tables["products"].select("product_id", *PRODUCT_ATTRIBUTES), "product_id", "left"
            )
        if named & {"seller_city", "seller_state"}:
            items = items.join(
                self.model.tables["sellers"].select("seller_id", "seller_city", "seller_state"), "seller_id", "left"
            )
        if "seller_alias" in named:
            items = items.join(self.seller_aliases, "seller_id", "left")
        for condition in listed(where_items):
            items = items.where(condition)
        return items.groupBy("order_id", *attributes).agg(
            F.sum("price").alias("revenue"), F.count(F.lit(1)).alias("items")
        )

    # ---------------------------------------------------------------- context
    def scope(
        self,
        by: Sequence[str] = (),
        where: Conditions = None,
        where_items: Conditions = None,
        need: Sequence[str] = (),
        with_items: bool = False,
    ) -> DataFrame:
        """Orders in context, one row per (order, item attributes of ``by``), with
        ``revenue`` and ``items`` of that pair. Counting rows of a group therefore
        counts distinct orders.

        ``with_items`` keeps only orders that have items."""
        attributes = [name for name in by if name in ITEM_ATTRIBUTES]
        rows = self.orders
        named = {*by, *need, *mentioned(where, (*CUSTOMER_ATTRIBUTES, *CALENDAR_ATTRIBUTES))}
        if named & set(CUSTOMER_ATTRIBUTES):
            rows = rows.join(self.customers, "customer_id", "left")
        if named & set(CALENDAR_ATTRIBUTES):
            # One row for each day of the calendar's years, whatever the number of orders: safe to broadcast.
            key = F.col("date").alias(f"date_{self.date_role}")
            days = F.broadcast(self.calendar.select(key, *CALENDAR_ATTRIBUTES))
            rows = rows.join(days, f"date_{self.date_role}", "left")
        for condition in listed(where):
            rows = rows.where(condition)
        how = "inner" if attributes or listed(where_items) or with_items else "left"
        return rows.join(self.items(attributes, where_items), "order_id", how)

    @cached_property
    def calendar(self) -> DataFrame:
        return calendar(self.model.tables["orders"], self.settings)

    @cached_property
    def months(self) -> DataFrame:
        """Calendar months: label, first and last day. One row per month."""
        days = calendar_days(self.model.tables["orders"], self.settings)
        return days.groupBy(dates.month_label(F.col("date")).alias("year_month")).agg(
            F.min("date").alias("month_start"), F.max("date").alias("month_end")
        )


def map_location(customers: DataFrame) -> Column:
    """``city, state``; a blank part counts as empty text."""
    return F.concat(
        F.coalesce(customers["customer_city"], F.lit("")),
        F.lit(", "),
        F.coalesce(customers["customer_state"], F.lit("")),
    )


def visible(df: DataFrame, *measures: str) -> DataFrame:
    """Rows a visual shows: those with at least one measure that is not blank."""
    shown = F.coalesce(*[F.col(m).cast("string") for m in measures])
    return df.where(shown.isNotNull())
