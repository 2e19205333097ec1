"""Lateness, lead times and review measures.

``delivery_panel`` defines every measure of the page over one pass; a single
measure selects its column and the optimizer drops the other aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bazaarlens.functions import text
from bazaarlens.functions.numbers import ratio, relative_change
from bazaarlens.operators.ordering import value_ranks
from bazaarlens.plans.measures.semantic import Conditions, Semantic, visible
from bazaarlens.session import cut_lineage

By = Sequence[str]

# A dashboard review is negative below this score (raw reviews, not order means).
NEGATIVE_BELOW = 4


def _count(condition: Column) -> Column:
    """Conditional count of distinct orders; none is blank."""
    return F.nullif(F.count_if(condition), F.lit(0))


def _days(start: str, end: str, condition: Column | None = None) -> Column:
    days = F.datediff(f"date_{end}", f"date_{start}")  # null when a date is missing
    return F.avg(days if condition is None else F.when(condition, days))


def delivery_panel(
    s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None
) -> DataFrame:
    late, on_time, delivered = F.col("is_late"), F.col("is_on_time"), F.col("is_delivered")
    score = F.col("order_score")
    facts = s.scope(by, where, where_items).groupBy(*by).agg(
        F.count(F.lit(1)).alias("orders"),
        _count(delivered).alias("delivered_orders"),
        _count(late).alias("late_orders"),
        _count(on_time).alias("on_time_orders"),
        _count(F.col("reviews") > 0).alias("_reviewed"),
        _count(F.col("lowest_score") < NEGATIVE_BELOW).alias("_negative"),
        F.avg("days_late").alias("average_days_late"),
        F.sum(F.when(delivered, F.col("days_late"))).alias("_delivered_days_late"),
        F.count(F.when(delivered, F.col("days_late"))).alias("_delivered_timed"),
        _days("purchase", "approved").alias("lead_purchase_approval"),
        _days("approved", "carrier").alias("lead_approval_carrier"),
        _days("carrier", "delivered").alias("lead_carrier_customer"),
        _days("purchase", "delivered", delivered).alias("lead_purchase_delivery"),
        F.avg(score).alias("average_score"),
        F.avg(F.when(late, score)).alias("average_score_late"),
        F.avg(F.when(on_time, score)).alias("average_score_on_time"),
    )
    late_share = ratio(F.col("late_orders"), F.col("delivered_orders"))
    on_time_share = ratio(F.col("on_time_orders"), F.col("delivered_orders"))
    # score loss of late orders relative to on-time ones
    impact = -relative_change(F.col("average_score_late"), F.col("average_score_on_time"))
    return facts.withColumns(
        {
            "late_share": late_share,
            "on_time_share": on_time_share,
            "late_share_of_orders": ratio(F.col("late_orders"), F.col("orders")),
            "negative_review_share": ratio(F.col("_negative"), F.col("_reviewed")),
            "late_impact": impact,
            "stars": text.star_rating(F.col("average_score")),
            "stars_late": text.star_rating(F.col("average_score_late")),
            "stars_on_time": text.star_rating(F.col("average_score_on_time")),
            # orders x mean days, as one division of whole numbers: equal scores are equal bits
            "delay_score": ratio(F.col("orders") * F.col("_delivered_days_late"), F.col("_delivered_timed")),
        }
    )


def panel_measure(column: str):
    """Measure function for one column of the panel."""

    def measure(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
        return visible(delivery_panel(s, by, where, where_items).select(*by, column), column)

    measure.__name__ = column
    return measure


late_impact = panel_measure("late_impact")  # M07
late_share = panel_measure("late_share")  # M08
on_time_share = panel_measure("on_time_share")  # M10
negative_review_share = panel_measure("negative_review_share")  # M11
average_days_late = panel_measure("average_days_late")  # M12
stars = panel_measure("stars")  # M13
stars_late = panel_measure("stars_late")  # M14
stars_on_time = panel_measure("stars_on_time")  # M15
lead_approval_carrier = panel_measure("lead_approval_carrier")  # M16
lead_purchase_approval = panel_measure("lead_purchase_approval")  # M17
lead_purchase_delivery = panel_measure("lead_purchase_delivery")  # M18
lead_carrier_customer = panel_measure("lead_carrier_customer")  # M19
average_score = panel_measure("average_score")  # M20; by seller M24
average_score_late = panel_measure("average_score_late")  # M21; by seller M22
average_score_on_time = panel_measure("average_score_on_time")  # M23
late_orders = panel_measure("late_orders")  # M25; by seller M54
on_time_orders = panel_measure("on_time_orders")  # M26


def by_seller(column: str, alias: str):
    """Seller measures: the order set is that of the seller's items."""

    def measure(
        s: Semantic, by: By = ("seller_id",), where: Conditions = None, where_items: Conditions = None
    ) -> DataFrame:
        return visible(delivery_panel(s, by, where, where_items).select(*by, F.col(column).alias(alias)), alias)

    measure.__name__ = alias
    return measure


late_share_by_seller = by_seller("late_share_of_orders", "late_share_by_seller")  # M09
average_score_late_by_seller = by_seller("average_score_late", "average_score_late_by_seller")  # M22
average_score_by_seller = by_seller("average_score", "average_score_by_seller")  # M24
orders_by_seller = by_seller("orders", "orders_by_seller")  # M27
late_orders_by_seller = by_seller("late_orders", "late_orders_by_seller")  # M54
delay_score_by_seller = by_seller("delay_score", "delay_score")  # M61


def seller_delay_rank(
    s: Semantic, by: By = ("seller_id",), where: Conditions = None, where_items: Conditions = None
) -> DataFrame:
    """Dense rank of the delay score among sellers with a positive one.

    The selection made by the conditions bounds the ranking; other ``by`` columns
    restart it. Blank unless the rows are sellers."""
    if "seller_id" not in by:
        scores = delay_score_by_seller(s, by, where, where_items)
        return scores.select(*by, F.lit(None).cast("bigint").alias("seller_delay_rank")).where(F.lit(False))
    scored = delay_score_by_seller(s, by, where, where_items).where(F.col("delay_score") > 0)
    groups = [name for name in by if name != "seller_id"]
    ranked = value_ranks(cut_lineage(scored), ["delay_score"], by=groups)
    return ranked.select(*by, F.col("delay_score_dense_desc").alias("seller_delay_rank"))
