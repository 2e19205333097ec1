"""Filter contexts: filters of one table removed, those of the others kept; roles, calendar attributes, forecast cells."""

import datetime as dt

import pytest

from bazaarlens.plans.measures import base, customers, forecast, logistics
from bazaarlens.plans.measures.semantic import PRODUCT_SIDE, SELLER_SIDE, Semantic, mentioned, without_filters
from bazaarlens.plans.model import Model
from bazaarlens.settings import Settings
from fixtures import item, order, tables

SELLERS = [("s1", "a", "north"), ("s2", "b", "south")]
PRODUCTS = [("p1", "toys"), ("p2", "books")]


def semantic(spark, role="purchase", settings=Settings(), **rows):
    return Semantic(Model(tables(spark, sellers=SELLERS, products=PRODUCTS, **rows), settings), role)


def test_conditions_belong_to_tables():
    assert mentioned("seller_state = 'product_id'", PRODUCT_SIDE) == []
    assert without_filters(["seller_id = 's1'", "product_category_name = 'toys'"], PRODUCT_SIDE) == ["seller_id = 's1'"]
    assert without_filters("price > 3", SELLER_SIDE) == ["price > 3"]
    assert without_filters(None, PRODUCT_SIDE) == []
    with pytest.raises(ValueError, match="state them apart"):
        without_filters("seller_state = 'north' OR product_id = 'p1'", PRODUCT_SIDE)


@pytest.fixture
def two_months(spark):
    """c1 bought books of s1, then toys of s1; c2 bought toys of s2, then toys of s1."""
    orders = [
        order("a", "c1", "2017-01-05T00:00", "2017-02-02T00:00", "2017-03-01T00:00"),
        order("b", "c1", "2017-02-05T00:00", "2017-02-20T00:00", "2017-02-10T00:00"),
        order("c", "c2", "2017-01-07T00:00", "2017-01-20T00:00", "2017-02-01T00:00"),
        order("d", "c2", "2017-02-09T00:00", "2017-03-20T00:00", "2017-04-01T00:00"),
    ]
    items = [item("a", 1, "p2", "s1"), item("b", 1, "p1", "s1"), item("c", 1, "p1", "s2"), item("d", 1, "p1", "s1")]
    people = [(f"c{i}", f"u{i}", "city", "state") for i in (1, 2)]
    return {"orders": orders, "order_items": items, "customers": people}


def test_removed_product_filter_keeps_the_seller_filter(spark, two_months):
    s = semantic(spark, **two_months)
    toys = "product_category_name = 'toys'"
    north = ["seller_state = 'north'", toys]
    # Any earlier order counts under a product filter; under the seller filter it must be one of that seller's.
    assert [tuple(r) for r in customers.returning_customers(s, where_items=toys).collect()] == [("2017-02", 2)]
    assert [tuple(r) for r in customers.returning_customers(s, where_items=north).collect()] == [("2017-02", 1)]
    assert customers.items_of_recurring_customers(s, where_items=north).first()[0] == 1
    assert customers.items_of_recurring_customers(s, where_items=toys).first()[0] == 3


def test_seller_filters_of_strategic_revenue(spark, two_months):
    s = semantic(spark, **two_months)
    assert forecast.strategic_revenue(s, where_items="seller_state = 'north'").first()[0] == 30.0
    assert forecast.strategic_revenue_share(s, where_items="seller_state = 'north'").first()[0] == 0.75
    # The ten are sought among all seller ids: a filter on the id is replaced.
    assert forecast.strategic_revenue(s, where_items="seller_id = 's2'").first()[0] == 40.0


@pytest.mark.parametrize(
    "role, months",
    [("purchase", {"2017-01": 20.0, "2017-02": 20.0}), ("delivered", {"2017-01": 10.0, "2017-02": 20.0, "2017-03": 10.0}),
     ("estimated", {"2017-02": 20.0, "2017-03": 10.0, "2017-04": 10.0})],
)
def test_roles(spark, two_months, role, months):
    s = semantic(spark, role, **two_months)
    assert dict(map(tuple, base.product_revenue(s, ["year_month"]).collect())) == months


def test_calendar_attributes(spark, two_months):
    s = semantic(spark, **two_months)
    assert dict(map(tuple, base.orders(s, ["weekday_name"], where="month_number = 2").collect())) == {"Sunday": 1, "Thursday": 1}
    assert base.orders(s, where="date BETWEEN '2017-01-06' AND '2017-02-05'").first()[0] == 2
    late = logistics.late_orders(s.with_role("estimated"), ["year", "quarter"], where_items="seller_alias = 'Seller #001'")
    assert [tuple(r) for r in late.collect()] == [(2017, "T1", 1)]


def test_forecast_cells(spark):
    """Real months differ by cell, the valid month and the sliders do not."""
    orders = [order(f"x{d}", "c1", f"2017-05-{d:02d}T00:00", None, None) for d in range(1, 32)]
    orders += [order("y", "c2", "2017-04-03T00:00", None, None), order("z", "c2", "2017-06-02T00:00", None, None)]
    people = [("c1", "u1", "p", "one"), ("c2", "u2", "q", "two")]
    items = [item(o[0], 1) for o in orders]
    s = semantic(spark, orders=orders, order_items=items, customers=people)
    assert forecast.last_valid_month(s).first()[0] == dt.date(2017, 5, 31)
    by = ["customer_state"]
    assert dict(map(tuple, forecast.last_real_month(s, by).collect())) == {"one": dt.date(2017, 5, 31), "two": dt.date(2017, 6, 30)}
    assert dict(map(tuple, forecast.baseline_value(s, by).collect())) == {"one": 310.0, "two": 10.0}
    # For "two" the month after the valid one is past: two of three months count.
    assert dict(map(tuple, forecast.baseline_3_months(s, by).collect())) == {"one": 930.0, "two": 20.0}
    settings = {"late_reduction": 10, "repurchase_increase": [0, 20], "seller_expansion": 0}
    rows = {(r[0], r[2]): r[4] for r in forecast.projected_3_months(s, by, params=settings).collect()}
    assert rows == pytest.approx({("one", 0): 930 * 1.01, ("one", 20): 930 * 1.01 * 1.02, ("two", 0): 20.2, ("two", 20): 20.2 * 1.02})
    assert forecast.forecast_simulated(s, by, where="customer_state = 'one'", params=settings).count() == 6
    assert forecast.projected_gain(s).count() == 31 * 21 * 21
    with pytest.raises(ValueError, match="no such slider"):
        forecast.projected_gain(s, params={"discount": 3})
