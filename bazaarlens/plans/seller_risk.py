"""Sellers ranked by the harm their late orders do to reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bazaarlens.functions.numbers import clip_low, ratio
from bazaarlens.operators.concentration import concentration
from bazaarlens.operators.control_charts import bubble_sizes
from bazaarlens.operators.ordering import running_totals
from bazaarlens.plans.logistics import global_review_gap
from bazaarlens.plans.model import Model
from bazaarlens.session import cut_lineage


def seller_scores(model: Model, min_orders: int | None = None) -> DataFrame:
    """One row per seller with delivered orders: volume x late rate x review impact."""
    least = model.settings.seller_min_orders if min_orders is None else min_orders
    score, late = F.col("review_score"), F.col("is_delayed")
    base = (
        model.seller_order_core.where("delivered_with_valid_dates")
        .groupBy("seller_id")
        .agg(
            F.count(F.lit(1)).alias("seller_orders"),
            F.sum("seller_order_revenue").alias("seller_revenue"),
            F.count_if(late).alias("delayed_orders"),
            F.avg("delay_days").alias("avg_delay_days"),
            F.avg("lead_time_days").alias("avg_lead_time_days"),
            F.avg(score).alias("avg_review_score"),
            F.avg(F.when(late, score)).alias("avg_late_review_score"),
            F.avg(F.when(~late, score)).alias("avg_on_time_review_score"),
        )
    )
    own_gap = F.col("avg_on_time_review_score") - F.col("avg_late_review_score")
    scored = base.withColumns(
        {
            "late_rate": ratio(F.col("delayed_orders"), F.col("seller_orders")),
            "impact_on_review": clip_low(F.coalesce(own_gap, global_review_gap(model))),
        }
    )
    return scored.withColumns(
        {
            "risk_score": F.col("seller_orders") * F.col("late_rate") * F.col("impact_on_review"),
            "eligible_risk_ranking": F.col("seller_orders") >= least,
        }
    )


# Equal scores may differ in the last bits, which depend on the order of summing:
# sellers are compared on this many digits and tie by id.
SCORE_DIGITS = 9


def _ranking() -> list[Column]:
    score = F.round("risk_score", SCORE_DIGITS)
    return [F.col("eligible_risk_ranking").desc(), score.desc(), F.col("seller_id").asc()]


def seller_risk(model: Model, min_orders: int | None = None) -> DataFrame:
    """Eligible sellers first, highest score first, ties by seller."""
    ranked = running_totals(seller_scores(model, min_orders), _ranking())
    return ranked.withColumnRenamed("position", "risk_rank").drop("position_total")


def eligible_scores(model: Model, min_orders: int | None = None) -> DataFrame:
    """Scores of sellers with enough orders; all of them when none has. Written
    once, because the check for "none" is a second reading."""
    scores = cut_lineage(seller_scores(model, min_orders))
    any_eligible = scores.agg(F.coalesce(F.bool_or("eligible_risk_ranking"), F.lit(False))).scalar()
    return scores.where(F.col("eligible_risk_ranking") | ~any_eligible)


def risk_pareto(model: Model, min_orders: int | None = None) -> DataFrame:
    return concentration(eligible_scores(model, min_orders), "seller_id", "risk_score")


def top_detractors(model: Model, n: int = 10, min_orders: int | None = None) -> DataFrame:
    """The ``n`` riskiest eligible sellers: an ordered limit, no full ranking.

    Eligible sellers come first, so ineligible ones can only be kept by the limit
    when fewer than ``n`` are eligible; they then count only if nobody is."""
    eligible = F.col("eligible_risk_ranking")
    first = seller_scores(model, min_orders).orderBy(*_ranking()).limit(n)
    # The window runs over at most n rows.
    anyone = F.bool_or(eligible).over(Window.partitionBy())
    return (
        first.withColumn("_anyone", anyone)
        .where(eligible | ~F.col("_anyone"))
        .select("seller_id", "seller_orders", "late_rate", "avg_delay_days", "avg_review_score", "risk_score")
    )


def risk_bubbles(model: Model, min_orders: int | None = None) -> DataFrame:
    risky = eligible_scores(model, min_orders)
    return bubble_sizes(risky, "late_rate", "seller_orders", "impact_on_review").select(
        "seller_id", "late_rate", "seller_orders", "impact_on_review", "bubble_size"
    )
