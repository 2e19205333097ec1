"""Every query by name: model -> DataFrame with stable, rounded output."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from bazaarlens.operators.concentration import top_rows
from bazaarlens.operators.control_charts import control_chart, linear_trend, p_chart, p_chart_points
from bazaarlens.plans import drivers, growth, logistics, monthly, report, repurchase, seller_risk, strategic
from bazaarlens.plans.measures import base, customers, forecast, sellers
from bazaarlens.plans.measures import logistics as service
from bazaarlens.plans.measures.semantic import DATE_ROLES, Semantic, map_location
from bazaarlens.plans.model import Model
from bazaarlens.sources.calendar import calendar
from bazaarlens.sources.csv_files import row_counts

Query = Callable[[Model], DataFrame]

_MONEY = re.compile(
    r"revenue|receita|price|^(open|high|low|close)$|baseline|projected|simulated|"
    r"center_line|control_limit|^value$|^trend$|slope|intercept"
)
_RATIO = re.compile(r"share|percentual|rate|pct|growth|revenue_trend|rank|weight|score|cum_")
_MONEY_MEAN = re.compile(r"ticket|order_value")
_FREIGHT = re.compile(r"freight")
# Products of a mean: cents lie below what two engines agree on, so whole units.
_PROJECTED = re.compile(r"projected|simulated")


def _digits(name: str) -> int:
    if _FREIGHT.search(name):
        return 4
    if _PROJECTED.search(name) and not _RATIO.search(name):
        return 0
    return 2 if _MONEY.search(name) and not _RATIO.search(name) else 6


def stable(df: DataFrame) -> DataFrame:
    """Doubles rounded (money to cents), dates of first-of-month kept, arrays joined."""
    columns = []
    for name, kind in df.dtypes:
        value = F.col(name)
        if kind == "double" and _MONEY_MEAN.search(name) and not _RATIO.search(name):
            value = F.round(value + 1e-6, 4)  # a mean of cents may end in an exact 5: push it up
        elif kind == "double":
            value = F.round(value, _digits(name)) + F.lit(0.0)  # -0.0 becomes 0.0
        elif kind.startswith("array"):
            value = F.array_join(value, ", ")
        columns.append(value.alias(name))
    return df.select(*columns)


def _order_level(m: Model) -> DataFrame:
    return m.order_level.drop("reference_timestamp")


def _item_fact(m: Model) -> DataFrame:
    return m.item_level.select(
        "order_id", "order_item_id", "product_id", "seller_id", "customer_unique_id", "customer_city",
        "customer_state", "product_category_final", "seller_city", "seller_state", "reference_date", "year_month",
        "item_revenue", "freight_value", "item_revenue_with_freight",
    )


def _order_date_keys(m: Model) -> DataFrame:
    orders = m.tables["orders"]
    named = orders.join(m.tables["customers"], "customer_id", "left")
    return named.select(
        "order_id",
        F.to_date("order_purchase_timestamp").alias("purchase_day"),
        *[F.to_date(column).alias(f"date_{role}") for role, column in DATE_ROLES.items()],
        map_location(named).alias("map_location"),
    )


def _control(value: str, lower_at_zero: bool) -> Query:
    return lambda m: control_chart(monthly.monthly_metrics(m), "year_month", value, lower_at_zero)


def _trend(value: str) -> Query:
    return lambda m: linear_trend(monthly.monthly_metrics(m), "year_month", value)


def _late_p(chart) -> Query:
    return lambda m: chart(
        monthly.monthly_metrics(m), "year_month", "delayed_orders", "delivered_orders_valid", "late_rate"
    )


# A threshold high enough to leave some sellers of the test tables out.
HIGH_MIN_ORDERS = 200

ANALYSES: dict[str, Query] = {
    "order_level": _order_level,
    "item_fact": _item_fact,
    "seller_order": lambda m: m.seller_order.drop("reference_timestamp"),
    "negative_review_threshold": lambda m: m.negative_threshold,
    "negative_review_flag": lambda m: m.order_level.where(F.col("review_score").isNotNull()).select(
        "order_id", "review_score", "negative_review_flag"
    ),
    "excluded_count": lambda m: m.excluded_count,
    "complete_month_bounds": lambda m: m.month_bounds,
    "daily_revenue": lambda m: m.daily_revenue,
    "monthly_ohlc": monthly.monthly_ohlc,
    "monthly_metrics": monthly.monthly_metrics,
    "monthly_enriched": strategic.monthly_enriched,
    "monthly_business_output": report.monthly_business_output,
    "concentration_city": growth.concentration_city,
    "concentration_seller": growth.concentration_seller,
    "concentration_category": growth.concentration_category,
    "concentration_state": growth.concentration_state,
    "pareto_top15_city": lambda m: top_rows(growth.concentration_city(m), 15),
    "pareto_top15_seller": lambda m: top_rows(growth.concentration_seller(m), 15),
    "control_revenue": _control("revenue_month", True),
    "control_orders": _control("orders_month", True),
    "control_review": _control("avg_review_score", False),
    "pchart_late": _late_p(p_chart),
    "pchart_late_points": _late_p(p_chart_points),
    "trend_revenue": _trend("revenue_month"),
    "trend_late_rate": _trend("late_rate"),
    "delay_vs_review": logistics.delay_vs_review,
    "seller_delay_review": logistics.seller_delay_review,
    "bubble_sizes": logistics.seller_delay_bubbles,
    "box_review_by_delay": logistics.review_boxes,
    "seller_risk": seller_risk.seller_risk,
    "seller_risk_high_volume": lambda m: seller_risk.seller_risk(m, HIGH_MIN_ORDERS),
    "risk_pareto": seller_risk.risk_pareto,
    "risk_bubbles": seller_risk.risk_bubbles,
    "top_detractors": seller_risk.top_detractors,
    "top_detractors_text": report.top_detractors_text,
    "customer_summary": repurchase.customer_summary,
    "repurchase_kpis": repurchase.repurchase_kpis,
    "monthly_repurchase": repurchase.monthly_repurchase,
    "repurchase_categories": repurchase.repurchase_categories,
    "repurchase_categories_text": report.top_repurchase_categories_text,
    "ticket_by_repurchase": repurchase.ticket_by_repurchase,
    "strategic_sellers": strategic.seller_performance,
    "strategic_monthly": strategic.strategic_monthly,
    "strategic_shares": strategic.strategic_shares,
    "kpi_summary": report.kpi_summary,
    "kpi_text": report.kpi_text,
    "load_summary": lambda m: row_counts(m.tables),
    "welch_review": logistics.review_welch,
    "welch_ticket": repurchase.ticket_welch,
    "mannwhitney_review": logistics.review_mann_whitney,
    "mannwhitney_ticket": repurchase.ticket_mann_whitney,
    "spearman_delay_review": logistics.delay_review_spearman_statistic,
    "review_tests_pvalues": logistics.review_tests,
    "ticket_tests_pvalues": repurchase.ticket_tests,
    "spearman_pvalue": logistics.delay_review_spearman,
    "tests_text": report.test_text,
    "driver_dataset": drivers.driver_dataset,
    "driver_correlation": drivers.driver_correlation,
    "driver_trend": drivers.driver_trend,
    "driver_ols": drivers.driver_ols,
    "driver_scenario": drivers.driver_scenario,
    "regression_output": drivers.regression_output,
    "negative_review_logit": logistics.negative_review_logit,
    "calendar": lambda m: calendar(m.tables["orders"], m.settings),
    "calendar_pt": lambda m: calendar(m.tables["orders"], m.settings, locale="pt"),
    "order_date_keys": _order_date_keys,
    "seller_alias": lambda m: sellers.seller_aliases(Semantic(m)),
}


def _measure(function, *args, role: str = "purchase", **kwargs) -> Query:
    return lambda m: function(Semantic(m, role), *args, **kwargs)


MONTH, STATE, CATEGORY, SELLER = "year_month", "customer_state", "product_category_name", "seller_id"

MEASURES: dict[str, Query] = {
    "m01_revenue_growth_card": _measure(base.revenue_growth_card),
    "m01_revenue_growth_card_by_state": _measure(base.revenue_growth_card, [STATE]),
    "m02_average_installments": _measure(base.average_installments, [MONTH]),
    "m02_average_installments_total": _measure(base.average_installments),
    "m03_orders": _measure(base.orders, [MONTH]),
    "m03_orders_by_category": _measure(base.orders, [CATEGORY]),
    "m03_orders_total": _measure(base.orders),
    "m04_revenue_by_delivery": _measure(base.revenue_by_delivery, [MONTH]),
    "m04_revenue_by_delivery_any_status": _measure(base.revenue_by_delivery, [MONTH], delivered_only=False),
    "m05_revenue_last_month": _measure(base.revenue_last_month),
    "m06_average_ticket": _measure(base.average_ticket, [MONTH]),
    "m06_average_ticket_by_category": _measure(base.average_ticket, [CATEGORY]),
    "m07_late_impact": _measure(service.late_impact, [MONTH]),
    "m08_late_share": _measure(service.late_share, [MONTH]),
    "m08_late_share_by_state": _measure(service.late_share, [STATE]),
    "m09_late_share_by_seller": _measure(service.late_share_by_seller),
    "m10_on_time_share": _measure(service.on_time_share, [MONTH]),
    "m11_negative_review_share": _measure(service.negative_review_share, [MONTH]),
    "m12_average_days_late": _measure(service.average_days_late, [MONTH]),
    "m13_stars": _measure(service.stars, [MONTH]),
    "m14_stars_late": _measure(service.stars_late, [MONTH]),
    "m15_stars_on_time": _measure(service.stars_on_time, [MONTH]),
    "m16_lead_approval_carrier": _measure(service.lead_approval_carrier, [MONTH]),
    "m17_lead_purchase_approval": _measure(service.lead_purchase_approval, [MONTH]),
    "m18_lead_purchase_delivery": _measure(service.lead_purchase_delivery, [MONTH]),
    "m19_lead_carrier_customer": _measure(service.lead_carrier_customer, [MONTH]),
    "m20_average_score": _measure(service.average_score, [MONTH]),
    "m20_average_score_by_category": _measure(service.average_score, [CATEGORY]),
    "m21_average_score_late": _measure(service.average_score_late, [MONTH]),
    "m22_average_score_late_by_seller": _measure(service.average_score_late_by_seller),
    "m23_average_score_on_time": _measure(service.average_score_on_time, [MONTH]),
    "m24_average_score_by_seller": _measure(service.average_score_by_seller),
    "m25_late_orders": _measure(service.late_orders, [MONTH]),
    "m26_on_time_orders": _measure(service.on_time_orders, [MONTH]),
    "m27_orders_by_seller": _measure(service.orders_by_seller),
    "m28_seller_delay_rank": _measure(service.seller_delay_rank),
    "m28_seller_delay_rank_by_month": _measure(service.seller_delay_rank, [MONTH, SELLER]),
    "m29_returning_share": _measure(customers.returning_share),
    "m30_returning_customers": _measure(customers.returning_customers),
    "m30_returning_customers_by_category": _measure(customers.returning_customers, [CATEGORY]),
    "m31_new_customers": _measure(customers.new_customers),
    "m32_unique_customers": _measure(customers.unique_customers, [MONTH]),
    "m32_unique_customers_by_category": _measure(customers.unique_customers, [CATEGORY]),
    "m33_purchase_frequency": _measure(customers.purchase_frequency, [MONTH]),
    "m33_purchase_frequency_total": _measure(customers.purchase_frequency),
    "m34_items_sold": _measure(base.items_sold, [MONTH]),
    "m34_items_sold_by_category": _measure(base.items_sold, [CATEGORY]),
    "m35_items_of_recurring_customers": _measure(customers.items_of_recurring_customers, [MONTH]),
    "m35_items_of_recurring_customers_by_category": _measure(
        customers.items_of_recurring_customers, [MONTH, CATEGORY]
    ),
    "m36_revenue_previous_3_months": _measure(customers.revenue_previous_3_months),
    "m37_revenue_last_3_months": _measure(customers.revenue_last_3_months),
    "m38_revenue_trend": _measure(customers.revenue_trend),
    "m38_revenue_trend_by_category": _measure(customers.revenue_trend, [CATEGORY]),
    "m39_top_1_revenue": _measure(sellers.top_seller_revenue(1)),
    "m40_top_1_seller": _measure(sellers.top_seller_alias(1)),
    "m41_top_2_revenue": _measure(sellers.top_seller_revenue(2)),
    "m42_top_2_seller": _measure(sellers.top_seller_alias(2)),
    "m43_top_3_revenue": _measure(sellers.top_seller_revenue(3)),
    "m44_top_3_seller": _measure(sellers.top_seller_alias(3)),
    "m45_strategic_revenue_share": _measure(forecast.strategic_revenue_share, [MONTH]),
    "m45_strategic_revenue_share_total": _measure(forecast.strategic_revenue_share),
    "m46_projected_gain_share": _measure(forecast.projected_gain_share),
    "m47_forecast_baseline": _measure(forecast.forecast_baseline),
    "m48_forecast_simulated": _measure(forecast.forecast_simulated),
    "m49_shown_history": _measure(forecast.shown_history),
    "m50_projected_3_months": _measure(forecast.projected_3_months),
    "m51_simulation_text": _measure(forecast.simulation_text),
    "m52_projected_gain": _measure(forecast.projected_gain),
    "m54_late_orders_by_seller": _measure(service.late_orders_by_seller),
    "m55_delivered_orders": _measure(base.delivered_orders, [MONTH]),
    "m56_baseline_3_months": _measure(forecast.baseline_3_months),
    "m57_base_revenue_3m": _measure(forecast.baseline_value),
    "m58_revenue_previous_month": _measure(base.revenue_previous_month),
    "m59_product_revenue": _measure(base.product_revenue, [MONTH]),
    "m59_product_revenue_by_state": _measure(base.product_revenue, [STATE]),
    "m59_product_revenue_by_category_in_asia": _measure(
        base.product_revenue, [CATEGORY], where="customer_state = 'ASIA'"
    ),
    "m60_strategic_revenue": _measure(forecast.strategic_revenue, [MONTH]),
    "m60_strategic_revenue_by_seller": _measure(forecast.strategic_revenue, [SELLER]),
    "m61_delay_score": _measure(service.delay_score_by_seller),
    "m62_last_valid_month": _measure(forecast.last_valid_month),
    "m63_last_real_date": _measure(forecast.last_real_date),
    "m64_last_real_month": _measure(forecast.last_real_month),
}

IN_ASIA, ONE_CATEGORY = "seller_state = 'ASIA'", "product_category_name = 'Brand#11'"
# Two slider settings of each kind, and one that is fixed.
SOME_SETTINGS = {"late_reduction": [0, 10], "repurchase_increase": 5, "seller_expansion": [0, 20]}

# Measures under slicers: seller and product filters, calendar attributes, date roles, forecast cells.
SLICED: dict[str, Query] = {
    "m01_revenue_growth_card_of_category": _measure(base.revenue_growth_card, where_items=ONE_CATEGORY),
    "m02_average_installments_of_asian_sellers": _measure(base.average_installments, [MONTH], where_items=IN_ASIA),
    "m03_orders_by_quarter": _measure(base.orders, ["year", "quarter"]),
    "m04_revenue_by_delivery_of_category": _measure(base.revenue_by_delivery, [MONTH], where_items=ONE_CATEGORY),
    "m04_revenue_by_delivery_by_year": _measure(base.revenue_by_delivery, ["year"], where="month_number <= 6"),
    "m08_late_share_by_weekday": _measure(service.late_share, ["weekday_number", "weekday_name"]),
    "m20_average_score_in_date_range": _measure(
        service.average_score, ["quarter"], where="date >= '1996-02-10' AND date < '1997-11-20'"
    ),
    "m27_orders_by_seller_alias": _measure(service.orders_by_seller, ["seller_alias"], where_items=ONE_CATEGORY),
    "m28_seller_delay_rank_in_asia": _measure(service.seller_delay_rank, where_items=IN_ASIA),
    "m29_returning_share_of_asian_sellers": _measure(customers.returning_share, where_items=IN_ASIA),
    "m30_returning_customers_of_asian_sellers": _measure(
        customers.returning_customers, [CATEGORY], where_items=[IN_ASIA, "product_category_name < 'Brand#3'"]
    ),
    "m35_items_of_recurring_customers_of_asian_sellers": _measure(
        customers.items_of_recurring_customers, [MONTH], where_items=[IN_ASIA, "product_category_name < 'Brand#3'"]
    ),
    "m39_top_1_revenue_of_category": _measure(sellers.top_seller_revenue(1), where_items=ONE_CATEGORY),
    "m44_top_3_seller_of_category": _measure(sellers.top_seller_alias(3), where_items=ONE_CATEGORY),
    "m45_strategic_revenue_share_of_asian_sellers": _measure(
        forecast.strategic_revenue_share, [MONTH], where_items=IN_ASIA
    ),
    "m46_projected_gain_share_by_state": _measure(forecast.projected_gain_share, [STATE], params=SOME_SETTINGS),
    "m47_forecast_baseline_by_state": _measure(forecast.forecast_baseline, [STATE]),
    "m48_forecast_simulated_by_state": _measure(forecast.forecast_simulated, [STATE], params=SOME_SETTINGS),
    "m49_shown_history_by_category": _measure(forecast.shown_history, [CATEGORY]),
    "m50_projected_3_months_by_state": _measure(forecast.projected_3_months, [STATE], params=SOME_SETTINGS),
    "m51_simulation_text_by_state": _measure(forecast.simulation_text, [STATE], params=SOME_SETTINGS),
    "m52_projected_gain_of_category": _measure(
        forecast.projected_gain, where_items=ONE_CATEGORY, params=SOME_SETTINGS
    ),
    "m56_baseline_3_months_by_state": _measure(forecast.baseline_3_months, [STATE]),
    "m57_base_revenue_3m_by_state": _measure(forecast.baseline_value, [STATE]),
    "m59_product_revenue_by_approved_month": _measure(base.product_revenue, [MONTH], role="approved"),
    "m59_product_revenue_by_carrier_month": _measure(base.product_revenue, [MONTH], role="carrier"),
    "m59_product_revenue_by_estimated_month": _measure(base.product_revenue, [MONTH], role="estimated"),
    "m63_last_real_date_by_state": _measure(forecast.last_real_date, [STATE]),
    "m64_last_real_month_by_category": _measure(forecast.last_real_month, [CATEGORY]),
}

QUERIES: dict[str, Query] = {**ANALYSES, **MEASURES, **SLICED}


def run(name: str, model: Model) -> DataFrame:
    return stable(QUERIES[name](model))
