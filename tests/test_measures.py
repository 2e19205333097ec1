"""Dashboard rules that the test tables do not reach."""

import datetime as dt

import pytest

from bazaarlens.plans.measures import base, customers, forecast, logistics, sellers
from bazaarlens.plans.measures.semantic import Semantic
from bazaarlens.plans.model import Model
from bazaarlens.settings import Settings
from fixtures import item, order, tables


def semantic(spark, settings=Settings(), **rows):
    return Semantic(Model(tables(spark, **rows), settings))


def test_late_by_date_and_blank_scores(spark):
    orders = [
        order("same_day", "c", "2017-03-01T00:00", "2017-03-10T18:00", "2017-03-10T06:00"),
        order("late", "c", "2017-03-01T00:00", "2017-03-12T01:00", "2017-03-10T23:00"),
    ]
    s = semantic(spark, orders=orders, order_items=[item(o[0], 1) for o in orders], order_reviews=[("same_day", 4.0)])
    assert logistics.late_orders(s, ["year_month"]).first()["late_orders"] == 1
    assert logistics.average_days_late(s).first()["average_days_late"] == 1.0
    assert logistics.late_impact(s).first()["late_impact"] == 1.0  # no late score: full loss
    assert logistics.average_score_late(s).count() == 0


def test_growth_over_an_empty_month(spark):
    orders = [
        order("a", "c", "2017-01-01T00:00", "2017-01-10T00:00", "2017-01-20T00:00"),
        order("b", "c", "2017-01-01T00:00", "2017-03-10T00:00", "2017-01-20T00:00"),
    ]
    s = semantic(spark, orders=orders, order_items=[item("a", 1), item("b", 1, price=30.0)])
    growth = {r["year_month"]: r["revenue_growth"] for r in base.revenue_growth_card(s).collect()}
    assert growth == {"2017-02": -1.0, "2017-04": -1.0}  # a blank previous month gives a blank
    assert {r["year_month"] for r in base.revenue_last_month(s).collect()} == {"2017-01", "2017-03"}


def test_podium_ties(spark):
    orders = [order(f"o{i}", "c", "2017-01-01T00:00", None, None) for i in range(3)]
    items = [item("o0", 1, seller="s1"), item("o1", 1, seller="s2"), item("o2", 1, seller="s3", price=5.0)]
    s = semantic(spark, orders=orders, order_items=items, sellers=[(f"s{i}", "a", "b") for i in (1, 2, 3)])
    assert sellers.top_seller_alias(1)(s).first()[0] == "Seller #002"
    assert sellers.top_seller_alias(2)(s).first()[0] is None  # two share first place
    assert sellers.top_seller_alias(3)(s).first()[0] == "Seller #003"
    assert sellers.top_seller_revenue(1)(s).first()[0] == "R$ 10"


def daily_orders(months, days):
    """One order on each of the first ``days`` days of each month."""
    return [
        order(f"{m}-{d}", "c", f"{m}-{d:02d}T12:00", None, None)
        for m in months
        for d in range(1, days[m] + 1)
    ]


def test_coverage_and_anchor_gap(spark):
    days = {"2017-04": 30, "2017-05": 31, "2017-06": 24, "2017-07": 24, "2017-08": 3}
    orders = daily_orders(days, days)  # June 24/30 = exactly 80 %, July 24/31 just below
    items = [item(o[0], 1, price=100.0) for o in orders]
    s = semantic(spark, orders=orders, order_items=items)
    assert forecast.last_valid_month(s).first()[0] == dt.date(2017, 6, 30)
    assert forecast.last_real_month(s).first()[0] == dt.date(2017, 8, 31)
    base_value = (3000.0 + 3100.0 + 2400.0) / 3
    assert forecast.baseline_value(s).first()[0] == pytest.approx(base_value)
    months = {r["year_month"]: r["forecast_baseline"] for r in forecast.forecast_baseline(s).collect()}
    assert months == pytest.approx({"2017-07": base_value, "2017-08": base_value, "2017-09": base_value})
    # only September lies after the last real month and inside the forecast window
    assert forecast.baseline_3_months(s).first()[0] == pytest.approx(base_value)
    grid = forecast.scenario_results(s)
    assert grid.count() == 31 * 21 * 21
    top = grid.where("late_reduction = 30 and repurchase_increase = 20 and seller_expansion = 20").first()
    assert top["impact"] == pytest.approx(1.03 * 1.02 * 1.16 - 1)
    sentence = forecast.simulation_text(s).where("late_reduction = 5 and repurchase_increase = 0 and seller_expansion = 0")
    assert sentence.first()["simulation_text"].startswith("Com redução de atraso de 5%, aumento de recompra de 0%")


def test_no_valid_month_gives_blanks(spark):
    s = semantic(spark, orders=daily_orders(["2017-04"], {"2017-04": 3}), order_items=[item("2017-04-1", 1)])
    assert forecast.last_valid_month(s).first()[0] is None
    assert forecast.forecast_baseline(s).count() == 0
    assert forecast.baseline_3_months(s).first()[0] is None


def test_returning_and_recurring_customers(spark):
    orders = [
        order("a", "c1", "2017-01-05T00:00", None, None, "shipped"),
        order("b", "c1", "2017-02-05T00:00", None, None, "shipped"),
        order("c", "c1", "2017-02-06T00:00", None, None, "shipped"),
        order("d", "c2", "2017-02-07T00:00", None, None, "shipped"),
    ]
    items = [item("a", 1, "toy"), item("b", 1, "book"), item("c", 1, "toy"), item("c", 2, "toy"), item("d", 1, "book")]
    s = semantic(
        spark, orders=orders, order_items=items, customers=[("c1", "u1", "x", "y"), ("c2", "u2", "x", "y")],
        products=[("toy", "toys"), ("book", "books")],
    )
    by = ["product_category_name"]
    found = {(r["year_month"], r["product_category_name"]): r["returning_customers"] for r in customers.returning_customers(s, by).collect()}
    # the January toy counts as an earlier order for February books as well
    assert found == {("2017-02", "books"): 1, ("2017-02", "toys"): 1}
    kept = {r["product_category_name"]: r[1] for r in customers.items_of_recurring_customers(s, by).collect()}
    assert kept == {"toys": 3, "books": 1}
    assert customers.returning_share(s).first()["returning_share"] == 0.5
    assert {r["year_month"]: r["new_customers"] for r in customers.new_customers(s).collect()} == {"2017-01": 1, "2017-02": 1}


def test_filters_and_roles(spark):
    orders = [
        order("a", "c1", "2017-01-05T00:00", "2017-02-01T00:00", "2017-03-01T00:00"),
        order("b", "c2", "2017-01-06T00:00", "2017-02-02T00:00", "2017-03-01T00:00"),
    ]
    items = [item("a", 1, seller="s1"), item("a", 2, seller="s2", price=7.0), item("b", 1, seller="s1", price=5.0)]
    s = semantic(spark, orders=orders, order_items=items, customers=[("c1", "u1", "x", "SP"), ("c2", "u2", "x", "RJ")])
    assert base.product_revenue(s, where="customer_state = 'SP'").first()[0] == 17.0
    assert base.orders(s, where_items="seller_id = 's2'").first()[0] == 1
    assert base.orders(s, ["seller_id"]).orderBy("seller_id").collect()[0]["orders"] == 2
    assert base.revenue_by_delivery(s, ["year_month"]).first()["year_month"] == "2017-02"
    assert forecast.strategic_revenue_share(s, ["customer_state"]).count() == 2
