"""Seller aliases and podium."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bazaarlens.functions import text
from bazaarlens.operators.ordering import value_ranks
from bazaarlens.plans.measures.semantic import Conditions, Semantic
from bazaarlens.session import cut_lineage

def seller_aliases(s: Semantic) -> DataFrame:
    return s.seller_aliases


def podium(s: Semantic, where: Conditions = None, where_items: Conditions = None, places: int = 3) -> DataFrame:
    """Sellers in the first ``places`` by the sum of three dense ranks (revenue,
    orders, items; lowest sum first, then revenue). Tied sellers share a place and
    push the next ones down, as in "top N with ties"."""
    totals = s.scope(["seller_id"], where, where_items).groupBy("seller_id").agg(
        F.sum("revenue").alias("revenue"),
        F.count(F.lit(1)).cast("double").alias("orders"),
        F.sum("items").cast("double").alias("items"),
    )
    ranked = value_ranks(cut_lineage(totals), ["revenue", "orders", "items"])
    scored = ranked.select(
        "seller_id",
        "revenue",
        (F.col("revenue_dense_desc") + F.col("orders_dense_desc") + F.col("items_dense_desc")).alias("rank_sum"),
    )
    # rank() <= places is cut per partition before the rows meet in one task.
    place = F.expr("rank() over (order by rank_sum asc, revenue desc)")
    return scored.withColumn("place", place).where(F.col("place") <= places)


def top_sellers(s: Semantic, where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    """One row per place 1..3: revenue text (M39, M41, M43) and alias.

    The k-th place is the top k without the top k-1; with ties it may be empty or
    hold several sellers, of which the largest revenue and alias are shown."""
    placed = podium(s, where, where_items).join(seller_aliases(s), "seller_id", "left")
    return placed.groupBy("place").agg(
        text.whole_currency(F.max("revenue")).alias("top_revenue"), F.max("seller_alias").alias("top_seller")
    )


def top_seller_revenue(place: int):
    def measure(s: Semantic, where: Conditions = None, where_items: Conditions = None) -> DataFrame:
        podium_place = podium(s, where, where_items, places=place).where(F.col("place") == place)
        revenue = text.whole_currency(F.max("revenue"))
        return podium_place.agg(revenue.alias(f"top_{place}_revenue"))

    return measure


def top_seller_alias(place: int):
    def measure(s: Semantic, where: Conditions = None, where_items: Conditions = None) -> DataFrame:
        podium_place = podium(s, where, where_items, places=place).where(F.col("place") == place)
        named = podium_place.join(seller_aliases(s), "seller_id", "left")
        return named.agg(F.max("seller_alias").alias(f"top_{place}_seller"))

    return measure
