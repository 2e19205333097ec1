"""Strategic sellers and the monthly series enriched with their share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bazaarlens.functions import dates
from bazaarlens.functions.numbers import positive_ratio, ratio
from bazaarlens.operators.months import keep_complete
from bazaarlens.operators.ordering import value_ranks
from bazaarlens.plans.model import Model
from bazaarlens.plans.monthly import monthly_metrics
from bazaarlens.session import cut_lineage

# Weight of each percentile rank in the score.
WEIGHTS = {"total_revenue": 0.5, "total_orders": 0.3, "total_items": 0.2}


def seller_performance(model: Model) -> DataFrame:
    """Totals per seller, average percentile ranks, weighted score, strategic flag.

    The flag goes to the best scores; ties prefer higher revenue, then the seller id.
    """
    totals = model.seller_month_kept.groupBy("seller_id").agg(
        F.sum("revenue").alias("total_revenue"),
        F.sum("orders").alias("total_orders"),
        F.sum("items").alias("total_items"),
    )
    ranked = value_ranks(cut_lineage(totals), list(WEIGHTS))
    percent = {f"{m}_pct_rank": F.col(f"{m}_avg_rank") / F.col(f"{m}_rank_rows") for m in WEIGHTS}
    weighted = {f"{m}_weight": F.col(f"{m}_pct_rank") * w for m, w in WEIGHTS.items()}
    scored = (
        ranked.withColumns(percent)
        .withColumns(weighted)
        .withColumn("strategic_score", sum(F.col(name) for name in weighted))
        .select("seller_id", *WEIGHTS, *percent, *weighted, "strategic_score")
    )
    best = (
        scored.orderBy(F.col("strategic_score").desc(), F.col("total_revenue").desc(), F.col("seller_id").asc())
        .limit(model.settings.strategic_sellers)
        .select("seller_id", F.lit(True).alias("_best"))
    )
    # `best` has at most `strategic_sellers` rows, so broadcasting it is safe.
    return scored.join(F.broadcast(best), "seller_id", "left").select(
        scored["*"], F.coalesce("_best", F.lit(False)).alias("strategic_seller")
    )


def strategic_monthly(model: Model, performance: DataFrame | None = None) -> DataFrame:
    """Per month: seller totals, strategic part and shares. An order of several
    sellers counts once for each of them."""
    performance = seller_performance(model) if performance is None else performance
    chosen = performance.where("strategic_seller").select("seller_id", F.lit(True).alias("strategic"))
    # At most `strategic_sellers` chosen rows: safe to broadcast.
    flagged = model.seller_month_kept.join(F.broadcast(chosen), "seller_id", "left")
    strategic = F.coalesce("strategic", F.lit(False))
    metrics = ("revenue", "orders", "items")
    monthly = flagged.groupBy("month").agg(
        *[F.sum(m).alias(f"total_{m}") for m in metrics],
        *[F.coalesce(F.sum(F.when(strategic, F.col(m))), F.lit(0)).alias(f"strategic_{m}") for m in metrics],
        F.min("first_delivery").alias("first_delivery"),
        F.max("last_delivery").alias("last_delivery"),
    )
    shares = monthly.withColumns(
        {
            "year_month": dates.month_label(F.col("month")),
            "strategic_revenue_share": positive_ratio(F.col("strategic_revenue"), F.col("total_revenue")),
            "strategic_orders_share": positive_ratio(F.col("strategic_orders"), F.col("total_orders")),
        }
    )
    return keep_complete(shares, "month", "first_delivery", "last_delivery", model.settings.start_date)


def strategic_shares(model: Model, performance: DataFrame | None = None) -> DataFrame:
    """One row: strategic share of all revenue and of the latest complete month."""
    performance = seller_performance(model) if performance is None else performance
    revenue = F.col("total_revenue")
    latest = strategic_monthly(model, performance).agg(F.max_by("strategic_revenue_share", "month")).scalar()
    return performance.agg(
        ratio(F.sum(F.when(F.col("strategic_seller"), revenue)), F.sum(revenue)).alias("strategic_global_share")
    ).withColumn("strategic_latest_share", latest)


def monthly_enriched(model: Model, performance: DataFrame | None = None) -> DataFrame:
    """Monthly metrics with strategic shares (missing shares count as 0)."""
    strategic = strategic_monthly(model, performance).select(
        "month", "strategic_revenue_share", "strategic_orders_share", "strategic_revenue", "strategic_orders"
    )
    return (
        monthly_metrics(model)
        .join(strategic, "month", "left")
        .fillna(0.0, subset=["strategic_revenue_share", "strategic_orders_share"])
    )
