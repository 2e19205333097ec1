"""Growth drivers: next-month growth explained by lateness, repurchase and
strategic sellers, and a what-if on the fitted line. One row per month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bazaarlens.functions.numbers import clip, ratio
from bazaarlens.operators import hypothesis, regression
from bazaarlens.plans.model import Model
from bazaarlens.plans.strategic import monthly_enriched
from bazaarlens.session import cut_lineage

DRIVERS = ("late_rate_pct", "repurchase_customer_rate_pct", "strategic_revenue_share_pct")
TARGET = "revenue_growth_m1_pct"
# Change of each driver in the scenario, in percentage points.
SCENARIO = {
    "late_rate_pct": -3.0,
    "repurchase_customer_rate_pct": 3.0,
    "strategic_revenue_share_pct": 3.0,
}


def driver_dataset(model: Model, winsor: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """Monthly drivers in percent with the revenue and growth of the next month.
    The adjusted growth is clipped to the ``winsor`` percentiles."""
    months = Window.orderBy("month")
    monthly = monthly_enriched(model).select(
        "month",
        "year_month",
        "revenue_month",
        (F.col("late_rate") * 100).alias("late_rate_pct"),
        (F.col("repurchase_customer_rate") * 100).alias("repurchase_customer_rate_pct"),
        (F.col("strategic_revenue_share") * 100).alias("strategic_revenue_share_pct"),
        F.lead("revenue_month").over(months).alias("next_month_revenue"),
        F.lead("year_month").over(months).alias("next_month_label"),
    )
    growth = (ratio(F.col("next_month_revenue"), F.col("revenue_month")) - 1) * 100
    monthly = monthly.withColumn(TARGET, growth)
    bounds = F.percentile(TARGET, F.array(*map(F.lit, winsor))).over(Window.partitionBy())
    monthly = monthly.withColumn("_bounds", bounds)
    adjusted = clip(F.col(TARGET), F.col("_bounds")[0], F.col("_bounds")[1])
    return monthly.withColumn(f"{TARGET}_winsorized", adjusted).drop("_bounds")


def driver_correlation(model: Model) -> DataFrame:
    return hypothesis.correlation_matrix(driver_dataset(model), [*DRIVERS, TARGET])


def driver_ols(model: Model) -> DataFrame:
    return regression.ols(driver_dataset(model), TARGET, DRIVERS)


def driver_trend(model: Model, driver: str = "strategic_revenue_share_pct") -> DataFrame:
    """One-driver least squares in closed form: one row."""
    x, y = F.col(driver), F.col(TARGET)
    return driver_dataset(model).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r_squared"),
        F.regr_count(y, x).alias("n_obs"),
    )


def _coefficients(fit: DataFrame) -> Column:
    """Scalar map term -> coefficient (one entry per term)."""
    return fit.agg(F.map_from_entries(F.collect_list(F.struct("term", "coef"))).alias("coefficients")).scalar()


def _with_prediction(monthly: DataFrame, fit: DataFrame) -> DataFrame:
    known = monthly.withColumn("_coef", _coefficients(fit))
    line = sum((F.col("_coef")[d] * F.col(d) for d in DRIVERS), F.col("_coef")["const"])
    return known.withColumn("predicted_growth_m1_pct", line).withColumn(
        "predicted_next_month_revenue", F.col("revenue_month") * (1 + F.col("predicted_growth_m1_pct") / 100)
    )


def regression_output(model: Model) -> DataFrame:
    """Published regression table with Portuguese headers."""
    monthly = cut_lineage(driver_dataset(model))
    fitted = _with_prediction(monthly, regression.ols(monthly, TARGET, DRIVERS))
    return fitted.select(
        F.col("year_month").alias("ano_mes"),
        F.col("revenue_month").alias("receita_mes"),
        F.col(TARGET).alias("crescimento_receita_m1_pct"),
        F.col(f"{TARGET}_winsorized").alias("crescimento_receita_m1_pct_ajustado"),
        F.col("late_rate_pct").alias("percentual_pedidos_atrasados"),
        F.col("repurchase_customer_rate_pct").alias("percentual_clientes_com_recompra"),
        F.col("strategic_revenue_share_pct").alias("percentual_receita_sellers_estrategicos"),
        F.col("predicted_growth_m1_pct").alias("baseline_crescimento_m1_pct"),
        F.col("predicted_next_month_revenue").alias("baseline_receita_m1"),
        F.col("next_month_revenue").alias("receita_m1_observada"),
        F.col("next_month_label").alias("ano_mes_m1"),
    )


def driver_scenario(model: Model) -> DataFrame:
    """One row: revenue of the month after the last one, as fitted and with the
    scenario changes applied to the drivers."""
    monthly = cut_lineage(driver_dataset(model))
    fitted = _with_prediction(monthly, regression.ols(monthly, TARGET, DRIVERS))
    change = sum(F.col("_coef")[d] * delta for d, delta in SCENARIO.items())
    scenario_growth = F.col("predicted_growth_m1_pct") + change
    return fitted.orderBy(F.col("month").desc()).limit(1).select(
        "year_month",
        "revenue_month",
        "predicted_growth_m1_pct",
        F.col("predicted_next_month_revenue").alias("baseline_revenue_m1"),
        scenario_growth.alias("scenario_growth_m1_pct"),
        (F.col("revenue_month") * (1 + scenario_growth / 100)).alias("scenario_revenue_m1"),
    )
