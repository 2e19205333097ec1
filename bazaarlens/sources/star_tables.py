"""Order-processing star schema (customer, orders, lineitem, ...) -> canonical tables.

A plain mapping: each canonical column is one expression over the source tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from bazaarlens.settings import Settings

# The window that covers the ship dates of these tables.
STAR_SETTINGS = Settings(
    start_date=dt.date(1995, 1, 1),
    end_date=dt.date(2001, 11, 30),
    calendar_start=dt.date(1995, 1, 1),
)


# Column types of the source tables. Declared, so opening a table runs no job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


class StarTables(Mapping):
    """Canonical tables, each built when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark = spark
        self._folder = folder
        self._build: dict[str, Callable[[], DataFrame]] = {
            "customers": self._customers,
            "orders": self._orders,
            "order_items": self._order_items,
            "order_payments": self._order_payments,
            "order_reviews": self._order_reviews,
            "products": self._products,
            "sellers": self._sellers,
            "translation": self._translation,
        }
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._build[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._build)

    def __len__(self) -> int:
        return len(self._build)

    def _source(self, name: str) -> DataFrame:
        return self._spark.read.schema(SCHEMAS[name]).parquet(f"{self._folder}/{name}.parquet")

    def _places(self) -> DataFrame:
        nation, region = self._source("nation"), self._source("region")
        return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
            "n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("state")
        )

    def _customers(self) -> DataFrame:
        located = self._source("customer").join(self._places(), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        return located.select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_custkey").alias("customer_unique_id"),
            F.col("city").alias("customer_city"),
            F.col("state").alias("customer_state"),
        )

    def _orders(self) -> DataFrame:
        shipped = (
            self._source("lineitem")
            .groupBy(F.col("l_orderkey").alias("o_orderkey"))
            .agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
        )
        status = (
            F.when(F.col("o_orderstatus") == "F", "delivered")
            .when(F.col("o_orderstatus") == "O", "shipped")
            .otherwise("processing")
        )
        return self._source("orders").join(shipped, "o_orderkey", "left").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            status.alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            F.expr("o_orderdate + interval 1 day").alias("order_approved_at"),
            F.col("first_ship").alias("order_delivered_carrier_date"),
            F.col("last_ship").alias("order_delivered_customer_date"),
            F.expr("o_orderdate + interval 730 day").alias("order_estimated_delivery_date"),
        )

    def _order_items(self) -> DataFrame:
        return self._source("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            F.col("l_extendedprice").alias("price"),
            (F.col("l_extendedprice") * F.col("l_tax") + 0.0).alias("freight_value"),
        )

    def _order_payments(self) -> DataFrame:
        kinds = self._source("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
        return self._source("lineitem").join(kinds, "l_orderkey").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("payment_sequential"),
            F.col("o_orderpriority").alias("payment_type"),
            (F.lit(1) + F.col("l_quantity").cast("int") % 12).alias("payment_installments"),
            (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("payment_value"),
        )

    def _order_reviews(self) -> DataFrame:
        return self._source("events").select(
            F.col("event_id").alias("review_id"),
            F.expr("event_id div 2").alias("order_id"),
            (F.lit(1) + F.floor("value") % 5).cast("double").alias("review_score"),
            F.col("ts").alias("review_creation_date"),
        )

    def _products(self) -> DataFrame:
        return self._source("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("product_category_name")
        )

    def _sellers(self) -> DataFrame:
        located = self._source("supplier").join(self._places(), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        return located.select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("city").alias("seller_city"),
            F.col("state").alias("seller_state"),
        )

    def _translation(self) -> DataFrame:
        """Lower-case names of the brands numbered up to 20; the others stay untranslated."""
        number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
        brands = self._source("part").where(number <= 20).select("p_brand").distinct()
        return brands.select(
            F.col("p_brand").alias("product_category_name"),
            F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("product_category_name_english"),
        )


def read_star(spark: SparkSession, folder: str) -> StarTables:
    return StarTables(spark, folder)
