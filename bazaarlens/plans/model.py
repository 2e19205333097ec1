"""Derived tables of the marketplace model, all lazy.

Facts are reduced to order grain before they meet another fact, so no join fans
out and a single hot order, product or seller is folded by partial aggregation
before the shuffle. Joins carry no broadcast hint: dimension sizes grow with the
data and are left to the optimizer, which checks them.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, Window, functions as F

from bazaarlens.functions import dates, text
from bazaarlens.functions.numbers import clip_low
from bazaarlens.operators.months import complete_bounds
from bazaarlens.operators.ordering import sequence_within
from bazaarlens.session import cut_lineage
from bazaarlens.settings import Settings

ORDER_DATES = (
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)


class Model:
    """Canonical tables plus everything derived from them.

    ``stored`` replaces derived tables by copies already written (see
    ``bazaarlens.plans.pipeline``), so one run computes each of them once.
    """

    def __init__(
        self,
        tables: Mapping[str, DataFrame],
        settings: Settings = Settings(),
        stored: Mapping[str, DataFrame] | None = None,
    ):
        self.tables = tables
        self.settings = settings
        self.stored = dict(stored or {})
        self.__dict__.update(self.stored)  # takes the place of the cached properties

    def storing(self, name: str, df: DataFrame) -> "Model":
        """A model that reads ``df`` for the derived table ``name``."""
        stored = {**self.stored, name: df}
        if name == "order_base":
            # It holds every column of the narrower order tables.
            stored.update(dict.fromkeys(("order_reviewed", "order_core", "delivered"), df))
        return Model(self.tables, self.settings, stored)

    @cached_property
    def with_orders_kept(self) -> "Model":
        """For queries that read order facts several times: the fact joins run
        once and the rest reads the written copy."""
        if "order_base" in self.stored:
            return self
        return self.storing("order_base", cut_lineage(self.order_base))

    @cached_property
    def with_order_facts_kept(self) -> "Model":
        """Like ``with_orders_kept`` for queries that ask for no number of sellers or products of an order. Both are
        distinct counts, for which Spark makes three rows of each item; a written column is never pruned."""
        if "order_base" in self.stored:
            return self
        return self.storing("order_base", cut_lineage(self.order_base.drop("seller_count", "product_count")))

    @property
    def spark(self):
        return self.tables["orders"].sparkSession

    # ------------------------------------------------------------ dimensions
    @cached_property
    def customers(self) -> DataFrame:
        return self.tables["customers"].select(
            "customer_id",
            "customer_unique_id",
            text.filled_title(F.col("customer_city")).alias("customer_city"),
            text.filled_upper(F.col("customer_state")).alias("customer_state"),
        )

    @cached_property
    def sellers(self) -> DataFrame:
        return self.tables["sellers"].select(
            "seller_id",
            text.filled_title(F.col("seller_city")).alias("seller_city"),
            text.filled_upper(F.col("seller_state")).alias("seller_state"),
        )

    @cached_property
    def products(self) -> DataFrame:
        """English category name, else the original one, else ``unknown``."""
        products = self.tables["products"].select("product_id", "product_category_name")
        names = [F.col("product_category_name"), F.lit("unknown")]
        translation = self.tables.get("translation")
        if translation is not None:
            products = products.join(
                translation.select("product_category_name", "product_category_name_english"),
                "product_category_name",
                "left",
            )
            names.insert(0, F.col("product_category_name_english"))
        return products.select("product_id", F.coalesce(*names).alias("product_category_final"))

    # ---------------------------------------------------------------- orders
    @cached_property
    def reviews(self) -> DataFrame:
        """Mean score and number of reviews per order."""
        reviews = self.tables["order_reviews"].where(F.col("order_id").isNotNull())
        return reviews.groupBy("order_id").agg(
            F.avg("review_score").alias("review_score"), F.count(F.lit(1)).alias("review_count")
        )

    @cached_property
    def delivered_any_time(self) -> DataFrame:
        """Delivered orders with a purchase and a delivery timestamp."""
        orders = self.tables["orders"]
        names = [name for name in ORDER_DATES if name in orders.columns]
        return orders.select(
            "order_id", "customer_id", text.filled_lower(F.col("order_status")).alias("order_status"), *names
        ).where(
            F.col("order_purchase_timestamp").isNotNull()
            & (F.col("order_status") == "delivered")
            & F.col("order_delivered_customer_date").isNotNull()
        )

    @property
    def _in_window(self):
        reference = F.col("order_delivered_customer_date")
        start = F.lit(self.settings.start_date).cast("timestamp_ntz")
        end = F.date_add(F.lit(self.settings.end_date), 1).cast("timestamp_ntz")
        return (reference >= start) & (reference < end)

    @cached_property
    def delivered(self) -> DataFrame:
        """Orders delivered inside the analysis window, with delivery facts."""
        reference = F.col("order_delivered_customer_date")
        estimated = F.col("order_estimated_delivery_date")
        valid = estimated.isNotNull()
        lead = dates.elapsed_days(F.col("order_purchase_timestamp"), reference)
        return self.delivered_any_time.where(self._in_window).select(
            "*",
            reference.alias("reference_timestamp"),
            F.to_date(reference).alias("reference_date"),
            dates.month_start(reference).alias("month"),
            dates.month_label(reference).alias("year_month"),
            valid.alias("delivered_with_valid_dates"),
            F.coalesce(valid & (reference > estimated), F.lit(False)).alias("is_delayed"),
            clip_low(dates.elapsed_days(estimated, reference)).alias("delay_days"),
            F.when(valid, clip_low(lead)).alias("lead_time_days"),
        )

    @cached_property
    def excluded_count(self) -> DataFrame:
        """Delivered orders outside the analysis window: one row."""
        return self.delivered_any_time.agg(
            F.count(F.lit(1)).alias("delivered_orders"),
            F.count_if(self._in_window).alias("kept_orders"),
            F.count_if(~self._in_window).alias("excluded_orders"),
        )

    @cached_property
    def order_sales(self) -> DataFrame:
        """Items folded to order grain (all orders) in one scan.

        A distinct count that a query does not use is dropped with its share of the shuffle."""
        return self.tables["order_items"].groupBy("order_id").agg(
            F.sum(F.coalesce(F.col("price"), F.lit(0.0))).alias("order_revenue"),
            F.count("order_item_id").alias("item_count"),
            F.count_distinct("seller_id").alias("seller_count"),
            F.count_distinct("product_id").alias("product_count"),
        )

    @cached_property
    def order_core(self) -> DataFrame:
        """Delivered orders that have at least one item."""
        return self.delivered.join(self.order_sales, "order_id")

    @cached_property
    def order_reviewed(self) -> DataFrame:
        return self.order_core.join(self.reviews, "order_id", "left")

    @cached_property
    def order_base(self) -> DataFrame:
        """Order grain with customer and review, before any per-customer numbering."""
        known = self.order_reviewed.join(self.customers, "customer_id", "left")
        return known.withColumns(
            {
                "customer_city": F.coalesce("customer_city", F.lit("Unknown")),
                "customer_state": F.coalesce("customer_state", F.lit("UNKNOWN")),
            }
        )

    @cached_property
    def negative_threshold(self) -> DataFrame:
        """One row: the score at or below which a review counts as negative."""
        s = self.settings
        negatives = F.count_if(F.col("review_score") <= s.negative_score)
        return self.order_reviewed.agg(
            negatives.alias("negative_reviews"),
            F.when(negatives < s.min_negative_reviews, F.lit(s.negative_score_fallback))
            .otherwise(F.lit(s.negative_score))
            .alias("negative_review_threshold"),
        )

    @cached_property
    def order_level(self) -> DataFrame:
        kept = self.with_orders_kept
        numbered = sequence_within(
            kept.order_base,
            key="customer_unique_id",
            when="order_purchase_timestamp",
            tie="order_id",
            position="customer_order_sequence",
            total="customer_total_orders",
        )
        threshold = kept.negative_threshold.select("negative_review_threshold").scalar()
        return numbered.withColumns(
            {
                "is_repurchase_order": F.col("customer_order_sequence") > 1,
                "customer_has_repurchase": F.col("customer_total_orders") > 1,
                "negative_review_threshold": threshold,
            }
        ).withColumn(
            "negative_review_flag",
            (F.col("review_score") <= F.col("negative_review_threshold")).cast("double"),
        )

    @cached_property
    def month_bounds(self) -> DataFrame:
        """One row: start, end and dropped labels of the complete months."""
        seen = self.order_core.agg(F.min("reference_timestamp").alias("first"), F.max("reference_timestamp").alias("last"))
        bounds = complete_bounds(F.col("first"), F.col("last"), self.settings.start_date)
        return seen.select(bounds.alias("bounds")).select("bounds.*")

    # ----------------------------------------------------------------- items
    @cached_property
    def item_level(self) -> DataFrame:
        """Items of delivered orders with customer, product and seller attributes."""
        price = F.coalesce(F.col("price"), F.lit(0.0))
        freight = F.coalesce(F.col("freight_value"), F.lit(0.0))
        orders = self.delivered.select(
            "order_id",
            "customer_id",
            "order_status",
            *[name for name in ORDER_DATES if name in self.tables["orders"].columns],
            "reference_timestamp",
            "reference_date",
            "month",
            "year_month",
        ).join(self.customers, "customer_id", "left")
        items = self.tables["order_items"].withColumns({"price": price, "freight_value": freight})
        return (
            items.join(orders, "order_id")
            .join(self.products, "product_id", "left")
            .join(self.sellers, "seller_id", "left")
            .withColumns(
                {
                    "product_category_final": F.coalesce("product_category_final", F.lit("unknown")),
                    "item_revenue": F.col("price"),
                    "item_revenue_with_freight": F.col("price") + F.col("freight_value"),
                }
            )
        )

    @cached_property
    def delivered_items(self) -> DataFrame:
        """Items of delivered orders, keys and revenue only (no dimension joins)."""
        return (
            self.tables["order_items"]
            .join(self.delivered.select("order_id"), "order_id", "left_semi")
            .select(
                "order_id",
                "product_id",
                "seller_id",
                F.coalesce(F.col("price"), F.lit(0.0)).alias("item_revenue"),
            )
        )

    @cached_property
    def seller_sales(self) -> DataFrame:
        """Items folded to (order, seller), all orders."""
        price = F.coalesce(F.col("price"), F.lit(0.0))
        items = self.tables["order_items"].where(F.col("seller_id").isNotNull())
        return items.groupBy("order_id", "seller_id").agg(
            F.sum(price).alias("seller_order_revenue"),
            F.count("order_item_id").alias("seller_item_count"),
            F.countDistinct("product_id").alias("seller_product_count"),
        )

    @cached_property
    def seller_order_core(self) -> DataFrame:
        """(order, seller) grain of delivered orders with delivery facts and score."""
        orders = self.delivered.select(
            "order_id",
            "order_purchase_timestamp",
            "reference_timestamp",
            "month",
            "year_month",
            "delivered_with_valid_dates",
            "is_delayed",
            "delay_days",
            "lead_time_days",
        ).join(self.reviews, "order_id", "left")
        return self.seller_sales.join(orders, "order_id")

    @cached_property
    def seller_order(self) -> DataFrame:
        threshold = self.negative_threshold.select("negative_review_threshold").scalar()
        return self.seller_order_core.join(self.sellers, "seller_id", "left").withColumn(
            "negative_review_flag", (F.col("review_score") <= threshold).cast("double")
        )

    # ---------------------------------------------------------------- reduced
    @cached_property
    def seller_month(self) -> DataFrame:
        """(month, seller) sums. An order has one delivery month, so distinct
        orders of a seller add up over months."""
        return self.seller_order_core.groupBy("month", "seller_id").agg(
            F.sum("seller_order_revenue").alias("revenue"),
            F.count(F.lit(1)).alias("orders"),
            F.sum("seller_item_count").alias("items"),
            F.min("reference_timestamp").alias("first_delivery"),
            F.max("reference_timestamp").alias("last_delivery"),
        )

    @cached_property
    def seller_month_kept(self) -> DataFrame:
        """One written copy: seller totals and monthly shares both read it."""
        return self.seller_month if "seller_month" in self.stored else cut_lineage(self.seller_month)

    @cached_property
    def daily_revenue(self) -> DataFrame:
        return self.order_core.groupBy(F.col("reference_date").alias("purchase_date")).agg(
            F.sum("order_revenue").alias("daily_revenue"), F.count(F.lit(1)).alias("daily_orders")
        )

    @cached_property
    def customer_month(self) -> DataFrame:
        """(customer, delivery month) sums: the one pass behind all monthly tables.

        Counts and sums fold before the shuffle, so a customer with a large part
        of all orders is at most one row per month afterwards.
        """
        s = self.settings
        valid = F.col("delivered_with_valid_dates")
        score = F.col("review_score")
        reduced = self.order_base.groupBy("customer_unique_id", "month").agg(
            F.sum("order_revenue").alias("revenue"),
            F.count(F.lit(1)).alias("orders"),
            F.count_if(valid).alias("valid_orders"),
            F.count_if(valid & F.col("is_delayed")).alias("delayed_orders"),
            F.sum("delay_days").alias("delay_sum"),
            F.sum("lead_time_days").alias("lead_sum"),
            F.sum(score).alias("score_sum"),
            F.count(score).alias("reviewed_orders"),
            F.count_if(score <= s.negative_score).alias("negative_orders"),
            F.count_if(score <= s.negative_score_fallback).alias("negative_orders_fallback"),
            F.min(F.struct("order_purchase_timestamp", "order_id")).alias("first_order"),
            F.min("reference_timestamp").alias("first_delivery"),
            F.max("reference_timestamp").alias("last_delivery"),
        )
        customer = Window.partitionBy("customer_unique_id")  # at most one row per month
        return reduced.withColumns(
            {
                "customer_orders": F.sum("orders").over(customer),
                "holds_first_order": F.col("first_order") == F.min("first_order").over(customer),
            }
        )
