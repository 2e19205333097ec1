"""Delivery delay and customer satisfaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bazaarlens.functions.numbers import ratio
from bazaarlens.operators import hypothesis, regression
from bazaarlens.operators.control_charts import box_statistics, bubble_sizes
from bazaarlens.plans.model import Model


def reviewed_orders(model: Model) -> DataFrame:
    return model.order_reviewed.where(F.col("delivered_with_valid_dates") & F.col("review_score").isNotNull())


def _gap_columns() -> list[Column]:
    score, late = F.col("review_score"), F.col("is_delayed")
    return [
        F.avg(score).alias("general_mean_review"),
        F.avg(F.when(~late, score)).alias("on_time_mean_review"),
        F.avg(F.when(late, score)).alias("delayed_mean_review"),
        F.avg("delay_days").alias("avg_delay_days"),
        F.count(F.lit(1)).alias("reviewed_orders"),
    ]


def delay_vs_review(model: Model) -> DataFrame:
    """One row: mean scores on time and late, the gap in points and percent."""
    gap = F.col("on_time_mean_review") - F.col("delayed_mean_review")
    return (
        reviewed_orders(model)
        .agg(*_gap_columns())
        .withColumns(
            {
                "review_gap_points": gap,
                "review_gap_pct": ratio(-gap, F.col("on_time_mean_review")) * 100,
            }
        )
    )


def global_review_gap(model: Model) -> Column:
    """Scalar: on-time minus late mean score, 0 when either is missing."""
    gap = delay_vs_review(model).select(F.coalesce("review_gap_points", F.lit(0.0)).alias("gap"))
    return gap.scalar()


def seller_delay_review(model: Model) -> DataFrame:
    """Sellers with enough reviewed orders: order count, mean delay, mean score."""
    rows = model.seller_order_core.where(F.col("delivered_with_valid_dates") & F.col("review_score").isNotNull())
    sellers = rows.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("seller_orders"),
        F.avg("delay_days").alias("avg_delay_days"),
        F.avg("review_score").alias("avg_review_score"),
    )
    return sellers.where(F.col("seller_orders") >= model.settings.seller_min_orders)


def seller_delay_bubbles(model: Model) -> DataFrame:
    return bubble_sizes(seller_delay_review(model), "avg_delay_days", "avg_review_score", "seller_orders")


def review_boxes(model: Model) -> DataFrame:
    """Score distribution on time and late; empty unless both groups exist."""
    boxes = box_statistics(reviewed_orders(model), "is_delayed", "review_score")
    groups = reviewed_orders(model).agg(F.bool_or("is_delayed") & F.bool_or(~F.col("is_delayed"))).scalar()
    return boxes.where(groups)


def review_welch(model: Model) -> DataFrame:
    return hypothesis.welch(reviewed_orders(model), "review_score", ~F.col("is_delayed"), model.settings.small_sample)


def review_mann_whitney(model: Model) -> DataFrame:
    return hypothesis.mann_whitney(reviewed_orders(model), "review_score", ~F.col("is_delayed"))


def review_tests(model: Model) -> DataFrame:
    return hypothesis.two_group_tests(
        reviewed_orders(model),
        "review_score",
        ~F.col("is_delayed"),
        "review score by lateness",
        model.settings.small_sample,
    )


def delay_review_spearman_statistic(model: Model) -> DataFrame:
    return hypothesis.spearman_statistic(reviewed_orders(model), "delay_days", "review_score")


def delay_review_spearman(model: Model) -> DataFrame:
    return hypothesis.spearman(reviewed_orders(model), "delay_days", "review_score", "delay days vs review score")


def negative_review_logit(model: Model) -> DataFrame:
    """Negative-review flag on delay days."""
    threshold = model.negative_threshold.select("negative_review_threshold").scalar()
    flagged = reviewed_orders(model).select(
        (F.col("review_score") <= threshold).cast("double").alias("negative_review_flag"), "delay_days"
    )
    return regression.logit(flagged, "negative_review_flag", "delay_days")
