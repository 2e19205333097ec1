"""Published tables and the executive figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bazaarlens.functions import text
from bazaarlens.operators.concentration import top_rows, top_share
from bazaarlens.plans import growth, logistics, repurchase, seller_risk, strategic
from bazaarlens.plans.model import Model

# Published column order, Portuguese header -> (source, factor).
BUSINESS_COLUMNS = {
    "ano_mes": ("year_month", None),
    "receita_mensal": ("revenue_month", None),
    "pedidos_mensais": ("orders_month", None),
    "ticket_medio_mensal": ("avg_ticket_month", None),
    "variacao_receita_mom_pct": ("revenue_mom_pct", None),
    "variacao_pedidos_mom_pct": ("orders_mom_pct", None),
    "variacao_ticket_mom_pct": ("ticket_mom_pct", None),
    "pedidos_entregues_validos": ("delivered_orders_valid", None),
    "pedidos_atrasados": ("delayed_orders", None),
    "taxa_atraso_pct": ("late_rate", 100),
    "atraso_medio_dias": ("avg_delay_days", None),
    "lead_time_medio_dias": ("avg_lead_time_days", None),
    "nota_media_mensal": ("avg_review_score", None),
    "taxa_reviews_negativas_pct": ("negative_review_rate", 100),
    "clientes_unicos": ("unique_customers", None),
    "novos_clientes": ("new_customers", None),
    "clientes_com_recompra": ("repurchase_customers", None),
    "taxa_clientes_com_recompra_pct": ("repurchase_customer_rate", 100),
    "percentual_receita_sellers_estrategicos": ("strategic_revenue_share", 100),
    "percentual_pedidos_sellers_estrategicos": ("strategic_orders_share", 100),
}


def business_output(enriched: DataFrame) -> DataFrame:
    """Rates in percent under published headers; absent columns are skipped."""
    chosen = []
    for header, (source, factor) in BUSINESS_COLUMNS.items():
        if source in enriched.columns:
            value = F.col(source) if factor is None else F.col(source) * factor
            chosen.append(value.alias(header))
    return enriched.select(*chosen)


def monthly_business_output(model: Model) -> DataFrame:
    return business_output(strategic.monthly_enriched(model))


def _as_struct(one_row: DataFrame) -> Column:
    return one_row.select(F.struct(*one_row.columns)).scalar()


def kpi_summary(model: Model) -> DataFrame:
    """One row of headline figures, built from scalar subqueries (no joins)."""
    model = model.with_order_facts_kept
    categories = growth.category_revenue(model, model.delivered_items)
    performance = strategic.seller_performance(model)
    return model.spark.range(1).select(
        _as_struct(top_share(growth.customer_revenue(model), "customer_city", "item_revenue", (1, 10))).alias("_city"),
        _as_struct(top_share(categories, "product_category_final", "item_revenue", (5, 10))).alias("_category"),
        _as_struct(top_share(model.delivered_items, "seller_id", "item_revenue", (10,))).alias("_seller"),
        _as_struct(logistics.delay_vs_review(model)).alias("_reviews"),
        _as_struct(repurchase.repurchase_kpis(model)).alias("_customers"),
        _as_struct(strategic.strategic_shares(model, performance)).alias("_strategic"),
    ).select(
        F.col("_city.top_1").alias("city_top1_share_pct"),
        F.col("_city.top_10").alias("city_top10_share_pct"),
        F.col("_category.top_5").alias("category_top5_share_pct"),
        F.col("_category.top_10").alias("category_top10_share_pct"),
        F.col("_seller.top_10").alias("seller_top10_share_pct"),
        "_reviews.general_mean_review",
        "_reviews.on_time_mean_review",
        "_reviews.delayed_mean_review",
        "_reviews.review_gap_points",
        "_reviews.review_gap_pct",
        "_customers.total_customers",
        "_customers.avg_orders_per_customer",
        "_customers.pct_customers_with_repurchase",
        "_customers.revenue_repurchase_customers",
        "_strategic.strategic_global_share",
        "_strategic.strategic_latest_share",
    )


def kpi_text(model: Model) -> DataFrame:
    """The headline figures as Brazilian text: one row per figure."""
    kpis = kpi_summary(model)
    entries = [
        ("city_top10_share", text.br_percent(F.col("city_top10_share_pct"))),
        ("city_top1_share", text.br_percent(F.col("city_top1_share_pct"))),
        ("category_top5_share", text.br_percent(F.col("category_top5_share_pct"))),
        ("category_top10_share", text.br_percent(F.col("category_top10_share_pct"))),
        ("seller_top10_share", text.br_percent(F.col("seller_top10_share_pct"))),
        ("on_time_mean_review", text.br_number(F.col("on_time_mean_review"))),
        ("delayed_mean_review", text.br_number(F.col("delayed_mean_review"))),
        ("review_gap_points", text.br_number(F.col("review_gap_points"))),
        ("review_gap_pct", text.br_percent(F.col("review_gap_pct"))),
        ("total_customers", text.br_integer(F.col("total_customers"))),
        ("avg_orders_per_customer", text.br_number(F.col("avg_orders_per_customer"))),
        ("pct_customers_with_repurchase", text.br_percent(F.col("pct_customers_with_repurchase"))),
        ("revenue_repurchase_customers", text.br_currency(F.col("revenue_repurchase_customers"))),
        ("revenue_axis_label", text.short_currency(F.col("revenue_repurchase_customers"))),
        ("strategic_global_share", text.br_percent(F.col("strategic_global_share") * 100)),
    ]
    cells = [F.struct(F.lit(name).alias("figure"), value.alias("text")) for name, value in entries]
    return kpis.select(F.inline(F.array(*cells)))


def test_text(model: Model) -> DataFrame:
    """Test results as text: Mann-Whitney p, Spearman rho and p."""
    tests = logistics.review_tests(model).select(text.br_pvalue(F.col("mannwhitney_pvalue"))).scalar()
    spearman = logistics.delay_review_spearman(model)
    return spearman.select(
        tests.alias("mannwhitney_pvalue"),
        text.br_number(F.col("rho")).alias("spearman_rho"),
        text.br_pvalue(F.col("pvalue")).alias("spearman_pvalue"),
    )


def top_detractors_text(model: Model) -> DataFrame:
    top = seller_risk.top_detractors(model)
    return top.select(
        "seller_id",
        "seller_orders",
        text.br_percent(F.col("late_rate") * 100).alias("late_rate"),
        text.br_number(F.col("avg_delay_days")).alias("avg_delay_days"),
        text.br_number(F.col("avg_review_score")).alias("avg_review_score"),
        text.br_number(F.col("risk_score")).alias("risk_score"),
    )


def top_repurchase_categories_text(model: Model, n: int = 10) -> DataFrame:
    top = top_rows(repurchase.repurchase_categories(model), n)
    return top.select(
        "product_category_final",
        text.br_currency(F.col("item_revenue")).alias("item_revenue"),
        text.br_percent(F.col("share") * 100).alias("share"),
        "rank",
    )
