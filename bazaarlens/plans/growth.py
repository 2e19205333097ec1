"""Revenue concentration, trends and control charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bazaarlens.operators.concentration import concentration
from bazaarlens.plans.model import Model


def customer_revenue(model: Model) -> DataFrame:
    """Delivered revenue folded to customers before the customer attributes are joined."""
    per_customer = model.order_core.groupBy("customer_id").agg(F.sum("order_revenue").alias("item_revenue"))
    return per_customer.join(model.customers, "customer_id", "left")


def concentration_city(model: Model) -> DataFrame:
    return concentration(customer_revenue(model), "customer_city", "item_revenue")


def concentration_state(model: Model) -> DataFrame:
    return concentration(customer_revenue(model), "customer_state", "item_revenue")


def concentration_seller(model: Model) -> DataFrame:
    return concentration(model.delivered_items, "seller_id", "item_revenue")


def category_revenue(model: Model, items: DataFrame) -> DataFrame:
    """Items folded to products first, so the product join sees one row per product."""
    per_product = items.groupBy("product_id").agg(F.sum("item_revenue").alias("item_revenue"))
    return per_product.join(model.products, "product_id", "left")


def concentration_category(model: Model) -> DataFrame:
    return concentration(category_revenue(model, model.delivered_items), "product_category_final", "item_revenue")
