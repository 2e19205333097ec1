"""Forecast page: anchors, baseline, what-if grid.

The passes over facts are monthly revenue, the latest purchase and per-month day
coverage; the rest works on context cells (one without ``by``), three months and the
slider settings of the scenario relation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from bazaarlens.functions import dates, text
from bazaarlens.functions.numbers import blank_minus, ratio
from bazaarlens.plans.measures import base
from bazaarlens.plans.measures.semantic import SELLER_SIDE, Conditions, Semantic, visible, without_filters
from bazaarlens.sources.calendar import MAX_LATE_REDUCTION, MAX_REPURCHASE_INCREASE, MAX_SELLER_EXPANSION

By = Sequence[str]

HORIZON = 3
# Effect of each slider on revenue.
LATE_EFFECT = 0.1
REPURCHASE_EFFECT = 0.1
SELLER_EFFECT = 0.8
# The sliders and their largest settings.
SLIDERS = {
    "late_reduction": MAX_LATE_REDUCTION,
    "repurchase_increase": MAX_REPURCHASE_INCREASE,
    "seller_expansion": MAX_SELLER_EXPANSION,
}


# ------------------------------------------------------------------ anchors
def last_real_date(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    """Latest purchase in the context, calendar filter removed."""
    return s.scope(by, where, where_items).groupBy(*by).agg(F.max("order_purchase_timestamp").alias("last_real_date"))


def last_real_month(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    """End of the month of the latest purchase."""
    return last_real_date(s, by, where, where_items).select(*by, F.last_day("last_real_date").alias("last_real_month"))


def last_valid_month(s: Semantic) -> DataFrame:
    """End of the last month with orders on enough of its days (M62): all orders
    count, whatever the context."""
    day = F.to_date("order_purchase_timestamp")
    days = s.model.tables["orders"].select(day.alias("day")).where(F.col("day").isNotNull()).distinct()
    start = F.lit(s.settings.calendar_start)
    covered = (
        days.where(F.col("day") >= start)
        .groupBy(F.last_day("day").alias("month_end"))
        .agg(F.count(F.lit(1)).alias("days"))
    )
    enough = covered.where(F.col("days") >= F.day("month_end") * F.lit(s.settings.month_coverage))
    return enough.agg(F.max("month_end").alias("last_valid_month"))


def monthly_revenue(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    """Revenue per purchase month of each context cell with the month's last day."""
    revenue = base.product_revenue(s, ["year_month", *by], where, where_items).where(F.col("year_month").isNotNull())
    end = F.last_day(F.to_date(F.concat("year_month", F.lit("-01"))))
    return revenue.withColumn("month_end", end)


def baseline_value(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    """Mean monthly revenue of the three months ending at the last valid one (M57),
    for each context cell. Months without revenue are blank and skipped."""
    anchor = last_valid_month(s).scalar()
    start = F.add_months(F.trunc(anchor, "MM"), 1 - HORIZON)
    used = monthly_revenue(s, by, where, where_items).where(F.col("month_end").between(start, anchor))
    return used.groupBy(*by).agg(F.avg("product_revenue").alias("base_revenue_3m"))


# ----------------------------------------------------------------- forecast
def forecast_months(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    """The calendar months one to three after the last valid one, for each context
    cell with its baseline (M47). The few months are spread from one array."""
    anchor = last_valid_month(s).scalar()
    ahead = dates.month_boundaries(anchor, F.col("month_end"))
    months = s.months.where(ahead.between(1, HORIZON)).agg(
        F.array_sort(F.collect_list(F.struct("year_month", "month_end"))).alias("months")
    )
    cells = baseline_value(s, by, where, where_items)
    return cells.select(*by, F.col("base_revenue_3m").alias("forecast_baseline"), F.inline(months.scalar()))


def forecast_baseline(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    months = forecast_months(s, by, where, where_items).select("year_month", *by, "forecast_baseline")
    return visible(months, "forecast_baseline")


def shown_history(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    """Revenue of months up to the last valid one."""
    anchor = last_valid_month(s).scalar()
    shown = monthly_revenue(s, by, where, where_items).where(F.col("month_end") <= anchor)
    return shown.select("year_month", *by, F.col("product_revenue").alias("shown_revenue"))


def _impact() -> Column:
    """Combined effect of the three sliders."""
    late = F.col("late_reduction") / F.lit(100.0) * LATE_EFFECT
    repurchase = F.col("repurchase_increase") / F.lit(100.0) * REPURCHASE_EFFECT
    expansion = F.col("seller_expansion") / F.lit(100.0) * SELLER_EFFECT
    return (1 + late) * (1 + repurchase) * (1 + expansion) - 1


Params = Mapping[str, int | Sequence[int]] | None


def with_scenarios(cells: DataFrame, params: Params = None) -> DataFrame:
    """The scenario relation: every context cell with every slider setting and its
    ``impact``. ``params`` fixes sliders to one value or some; others take all."""
    unknown = set(params or ()) - set(SLIDERS)
    if unknown:
        raise ValueError(f"no such slider: {sorted(unknown)}")
    for name, last in SLIDERS.items():
        chosen = (params or {}).get(name)
        if chosen is None:
            values = F.sequence(F.lit(0), F.lit(last))
        else:
            values = F.array(*[F.lit(int(v)) for v in ([chosen] if isinstance(chosen, int) else chosen)])
        cells = cells.withColumn(name, F.explode(values))
    return cells.withColumn("impact", _impact())


def forecast_simulated(
    s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None, params: Params = None
) -> DataFrame:
    """Baseline x (1 + impact) for every cell, slider setting and forecast month."""
    months = visible(forecast_months(s, by, where, where_items), "forecast_baseline")
    value = F.col("forecast_baseline") * (1 + F.col("impact"))
    return with_scenarios(months, params).select("year_month", *by, *SLIDERS, value.alias("forecast_simulated"))


def baseline_3_months(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    """Sum of the baseline over the three months after the last *real* month of the
    cell (M56). Where that month is later than the last valid one, fewer months
    have a value; where it is earlier, those too far after it do not count."""
    months = forecast_months(s, by, where, where_items)
    if not by:
        real = last_real_month(s, (), where, where_items).scalar()
        counted = dates.month_boundaries(real, F.col("month_end")).between(1, HORIZON)
        return months.where(counted).agg(F.sum("forecast_baseline").alias("baseline_3_months"))
    real = last_real_month(s, by, where, where_items).select(*[F.col(c).alias(f"_{c}") for c in by], "last_real_month")
    match = reduce(lambda m, c: m & F.col(c).eqNullSafe(F.col(f"_{c}")), by, F.lit(True))
    counted = dates.month_boundaries(F.col("last_real_month"), F.col("month_end")).between(1, HORIZON)
    inside = F.sum(F.when(counted, F.col("forecast_baseline")))
    return months.join(real, match).groupBy(*by).agg(inside.alias("baseline_3_months"))


def scenario_results(
    s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None, params: Params = None
) -> DataFrame:
    """Per cell and slider setting: projected revenue (M50), gain (M52), gain share."""
    scenarios = with_scenarios(baseline_3_months(s, by, where, where_items), params)
    projected = scenarios.withColumn("projected_3_months", F.col("baseline_3_months") * (1 + F.col("impact")))
    gain = blank_minus(F.col("projected_3_months"), F.col("baseline_3_months"))
    return projected.withColumn("projected_gain", gain).withColumn(
        "projected_gain_share", ratio(F.col("projected_gain"), F.col("baseline_3_months"))
    )


def scenario_measure(*columns: str):
    def measure(
        s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None, params: Params = None
    ) -> DataFrame:
        return scenario_results(s, by, where, where_items, params).select(*by, *SLIDERS, *columns)

    return measure


projected_gain_share = scenario_measure("projected_gain_share")  # M46
projected_3_months = scenario_measure("projected_3_months")  # M50
projected_gain = scenario_measure("projected_gain")  # M52
simulation_impact = scenario_measure("impact", "baseline_3_months")  # M53 with the baseline it applies to


def simulation_text(
    s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None, params: Params = None
) -> DataFrame:
    """Narrative sentence per cell and slider setting."""

    def blank_text(value: Column) -> Column:
        return F.coalesce(value, F.lit(""))

    def percent(name: str) -> Column:
        return text.whole_percent(F.col(name) / F.lit(100.0))

    # Wording of the dashboard sentence.
    sentence = F.concat(
        F.lit("Com redução de atraso de "),
        percent("late_reduction"),
        F.lit(", aumento de recompra de "),
        percent("repurchase_increase"),
        F.lit(" e expansão de sellers estratégicos de "),
        percent("seller_expansion"),
        F.lit(", a receita projetada para os próximos 3 meses é de "),
        blank_text(text.whole_currency(F.col("projected_3_months"))),
        F.lit(", representando uma variação de "),
        blank_text(text.one_decimal_percent(F.col("projected_gain_share"))),
        F.lit(" sobre o baseline."),
    )
    return scenario_results(s, by, where, where_items, params).select(*by, *SLIDERS, sentence.alias("simulation_text"))


# -------------------------------------------------------- strategic sellers
def _strategic_panel(s: Semantic, by: By, where: Conditions, where_items: Conditions) -> DataFrame:
    """Revenue of the ten best sellers of each context.

    Seller attributes in ``by`` do not change who the ten are; they split the
    strategic revenue. The ten come from all seller ids, so a filter on the id is
    replaced; filters on other seller attributes and on products stay."""
    context = [name for name in by if name not in SELLER_SIDE]
    seller_columns = [name for name in by if name in SELLER_SIDE]
    extra = [name for name in seller_columns if name != "seller_id"]
    kept = without_filters(where_items, ["seller_id"])
    sellers = s.scope([*context, "seller_id", *extra], where, kept).groupBy(*context, "seller_id", *extra).agg(
        F.sum("revenue").alias("revenue")
    )
    best = Window.partitionBy(*context).orderBy(F.col("revenue").desc(), F.col("seller_id").asc())
    # row_number() <= n is cut per partition before the shuffle.
    ten = sellers.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= s.settings.strategic_sellers)
    return ten.groupBy(*by).agg(F.sum("revenue").alias("strategic_revenue"))


def strategic_revenue(s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None) -> DataFrame:
    """Revenue of the ten sellers with most revenue in the context."""
    return visible(_strategic_panel(s, by, where, where_items), "strategic_revenue")


def strategic_revenue_share(
    s: Semantic, by: By = (), where: Conditions = None, where_items: Conditions = None
) -> DataFrame:
    """M60 over revenue with seller filters removed."""
    context = [name for name in by if name not in SELLER_SIDE]
    part = strategic_revenue(s, by, where, where_items)
    all_sellers = without_filters(where_items, SELLER_SIDE)
    if not context:
        whole = base.product_revenue(s, (), where, all_sellers).scalar()
        return part.select(*by, ratio(F.col("strategic_revenue"), whole).alias("strategic_revenue_share"))
    whole = base.product_revenue(s, context, where, all_sellers).select(
        *[F.col(c).alias(f"_{c}") for c in context], "product_revenue"
    )
    match = F.lit(True)
    for name in context:
        match = match & F.col(name).eqNullSafe(F.col(f"_{name}"))
    joined = part.join(whole, match)
    return joined.select(*by, ratio(F.col("strategic_revenue"), F.col("product_revenue")).alias("strategic_revenue_share"))
