"""Hand-made marketplace tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

SCHEMAS = {
    "customers": "customer_id string, customer_unique_id string, customer_city string, customer_state string",
    "orders": "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz, "
    "order_approved_at timestamp_ntz, order_delivered_carrier_date timestamp_ntz, "
    "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz",
    "order_items": "order_id string, order_item_id double, product_id string, seller_id string, "
    "shipping_limit_date timestamp_ntz, price double, freight_value double",
    "order_payments": "order_id string, payment_sequential double, payment_type string, payment_installments double, payment_value double",
    "order_reviews": "order_id string, review_score double",
    "products": "product_id string, product_category_name string",
    "sellers": "seller_id string, seller_city string, seller_state string",
    "translation": "product_category_name string, product_category_name_english string",
}


def at(text: str | None):
    return None if text is None else dt.datetime.fromisoformat(text)


def order(order_id, customer, purchase, delivered, estimated, status="delivered"):
    approved = carrier = at(purchase)
    return (order_id, customer, status, at(purchase), approved, carrier, at(delivered), at(estimated))


def item(order_id, number, product="p1", seller="s1", price=10.0, freight=1.0):
    return (order_id, float(number), product, seller, None, price, freight)


def tables(spark: SparkSession, **rows):
    """Tables from rows; those not given are empty (translation absent unless given)."""
    made = {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()}
    if "translation" not in rows:
        del made["translation"]
    return made
