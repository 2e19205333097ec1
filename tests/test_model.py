"""Rules of the derived tables on a few rows each."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bazaarlens.operators.months import complete_bounds
from bazaarlens.plans import logistics, monthly, repurchase, seller_risk, strategic
from bazaarlens.plans.model import Model
from bazaarlens.settings import Settings
from fixtures import at, item, order, tables


def test_window_edges_status_and_missing_items(spark):
    orders = [
        order("first", "c", "2016-12-01T10:00", "2017-01-01T00:00", "2017-02-01T00:00", "DELIVERED"),
        order("last", "c", "2018-08-01T10:00", "2018-08-31T23:59:59", "2018-09-30T00:00"),
        order("after", "c", "2018-08-01T10:00", "2018-09-01T00:00", "2018-09-30T00:00"),
        order("before", "c", "2016-08-01T10:00", "2016-12-31T23:59:59", "2018-09-30T00:00"),
        order("shipped", "c", "2018-01-01T10:00", "2018-02-01T00:00", "2018-09-30T00:00", "shipped"),
        order("unknown", "c", "2018-01-01T10:00", "2018-02-01T00:00", "2018-09-30T00:00", None),
        order("no_purchase", "c", None, "2018-02-01T00:00", "2018-09-30T00:00"),
        order("no_item", "c", "2018-01-01T10:00", "2018-02-01T00:00", "2018-09-30T00:00"),
    ]
    items = [item(o[0], 1) for o in orders if o[0] != "no_item"]
    model = Model(tables(spark, orders=orders, order_items=items, customers=[("c", "u", None, None)]))
    rows = {r["order_id"]: r for r in model.order_level.collect()}
    assert set(rows) == {"first", "last"}
    assert rows["first"]["customer_city"] == "Unknown" and rows["first"]["customer_state"] == "UNKNOWN"
    assert tuple(model.excluded_count.first()) == (5, 3, 2)


def test_lateness_by_timestamp_and_clipping(spark):
    orders = [
        order("same_day", "c", "2017-03-01T00:00", "2017-03-10T18:00", "2017-03-10T06:00"),
        order("early", "c", "2017-03-01T00:00", "2017-03-05T00:00", "2017-03-10T00:00"),
        order("no_estimate", "c", "2017-03-01T00:00", "2017-03-05T00:00", None),
        order("odd", "c", "2017-03-09T00:00", "2017-03-05T00:00", "2017-03-10T00:00"),
    ]
    model = Model(tables(spark, orders=orders, order_items=[item(o[0], 1) for o in orders]))
    rows = {r["order_id"]: r for r in model.order_level.collect()}
    assert rows["same_day"]["is_delayed"] and rows["same_day"]["delay_days"] == 0.5
    assert not rows["early"]["is_delayed"] and rows["early"]["delay_days"] == 0.0
    assert rows["no_estimate"]["delay_days"] is None and rows["no_estimate"]["lead_time_days"] is None
    assert rows["no_estimate"]["is_delayed"] is False and rows["no_estimate"]["delivered_with_valid_dates"] is False
    assert rows["odd"]["lead_time_days"] == 0.0


def test_category_chain(spark):
    made = tables(
        spark,
        products=[("p1", "cama"), ("p2", "pc_gamer"), ("p3", None)],
        translation=[("cama", "bed")],
    )
    found = dict(Model(made).products.collect())
    assert found == {"p1": "bed", "p2": "pc_gamer", "p3": "unknown"}
    del made["translation"]
    assert dict(Model(made).products.collect()) == {"p1": "cama", "p2": "pc_gamer", "p3": "unknown"}


def test_sequence_tie_and_adaptive_threshold(spark):
    orders = [
        order("b", "c", "2017-03-01T00:00", "2017-03-05T00:00", "2017-03-10T00:00"),
        order("a", "c", "2017-03-01T00:00", "2017-04-05T00:00", "2017-03-10T00:00"),
        order("z", "c", "2017-02-01T00:00", "2017-05-05T00:00", "2017-03-10T00:00"),
    ]
    reviews = [("a", 1.0), ("a", 4.0), ("b", 3.0), ("z", 5.0)]
    made = tables(
        spark, orders=orders, order_items=[item(o[0], 1) for o in orders],
        customers=[("c", "u", "x", "y")], order_reviews=reviews,
    )
    rows = {r["order_id"]: r for r in Model(made).order_level.collect()}
    assert [rows[k]["customer_order_sequence"] for k in ("z", "a", "b")] == [1, 2, 3]
    assert rows["a"]["review_score"] == 2.5 and rows["a"]["review_count"] == 2
    assert {k: r["negative_review_flag"] for k, r in rows.items()} == {"a": 1.0, "b": 1.0, "z": 0.0}
    strict = Model(made, Settings(min_negative_reviews=0))
    assert strict.negative_threshold.first()["negative_review_threshold"] == 2.0


def test_two_definitions_of_new_customers(spark):
    orders = [
        order("a", "c1", "2017-01-20T00:00", "2017-02-10T00:00", "2017-03-10T00:00"),
        order("b", "c1", "2017-02-25T00:00", "2017-02-28T00:00", "2017-03-10T00:00"),
        order("c", "c2", "2017-01-02T00:00", "2017-01-31T00:00", "2017-03-10T00:00"),
    ]
    made = tables(
        spark, orders=orders, order_items=[item(o[0], 1) for o in orders],
        customers=[("c1", "u1", "x", "y"), ("c2", "u2", "x", "y")],
    )
    model = Model(made)
    metrics = {r["year_month"]: r for r in monthly.monthly_metrics(model).collect()}
    page = {r["year_month"]: r for r in repurchase.monthly_repurchase(model).collect()}
    assert {k: r["new_customers"] for k, r in metrics.items()} == {"2017-01": 1, "2017-02": 1}
    assert {k: r["new_customers"] for k, r in page.items()} == {"2017-01": 2, "2017-02": 0}
    assert metrics["2017-02"]["repurchase_customers"] == page["2017-02"]["repurchase_customers"] == 1
    assert page["2017-02"]["avg_ticket_non_repurchase_customers"] is None


@pytest.mark.parametrize(
    "first, last, start, end, dropped",
    [
        ("2017-01-05", "2017-04-30", "2017-01-01", "2017-04-01", []),  # start forced back
        ("2016-11-05", "2017-04-29", "2016-12-01", "2017-03-01", ["2016-11", "2017-04"]),
        ("2016-11-01", "2017-04-30", "2016-11-01", "2017-04-01", []),
        ("2016-11-03", "2016-11-20", "2016-11-01", "2016-11-01", []),  # nothing left: keep all
        (None, None, None, None, None),
    ],
)
def test_complete_month_bounds(spark, first, last, start, end, dropped):
    df = spark.createDataFrame([(at(first), at(last))], "f timestamp_ntz, l timestamp_ntz")
    got = df.select(complete_bounds(F.col("f"), F.col("l"), dt.date(2017, 1, 1))).first()[0]
    if first is None:
        assert got is None
    else:
        assert (str(got["start"]), str(got["end"]), got["dropped"]) == (start, end, dropped)


def marketplace(spark):
    """Two sellers in one order, a late reviewed order, a seller without reviews."""
    orders = [
        order("o1", "c1", "2017-01-01T00:00", "2017-01-10T00:00", "2017-01-05T00:00"),
        order("o2", "c1", "2017-01-01T00:00", "2017-01-04T00:00", "2017-01-05T00:00"),
        order("o3", "c2", "2017-01-01T00:00", "2017-01-31T00:00", "2017-01-05T00:00"),
    ]
    items = [item("o1", 1, seller="s1"), item("o1", 2, seller="s2"), item("o2", 1, seller="s1"), item("o3", 1, seller="s3")]
    return tables(
        spark, orders=orders, order_items=items, order_reviews=[("o1", 2.0), ("o2", 5.0)],
        customers=[("c1", "u1", "x", "y"), ("c2", "u2", "x", "y")], sellers=[("s1", "a", "b"), ("s2", "a", "b"), ("s3", "a", "b")],
    )


def test_seller_risk_gap_and_eligibility(spark):
    model = Model(marketplace(spark))
    risk = {r["seller_id"]: r for r in seller_risk.seller_risk(model).collect()}
    assert risk["s1"]["impact_on_review"] == 3.0 and risk["s1"]["late_rate"] == 0.5
    assert risk["s3"]["impact_on_review"] == 3.0  # no own scores: the global gap
    assert {r["eligible_risk_ranking"] for r in risk.values()} == {False}
    assert [r["seller_id"] for r in seller_risk.top_detractors(model).collect()] == ["s1", "s2", "s3"]
    assert [r["seller_id"] for r in seller_risk.top_detractors(model, min_orders=2).collect()] == ["s1"]
    assert seller_risk.risk_pareto(model).count() == 3 and seller_risk.risk_pareto(model, 2).count() == 1


def test_order_of_two_sellers_counts_twice(spark):
    model = Model(marketplace(spark))
    month = strategic.strategic_monthly(model).first()
    assert month["total_orders"] == 4 and monthly.monthly_metrics(model).first()["orders_month"] == 3
    assert month["strategic_revenue_share"] == 1.0


def test_delay_vs_review_one_sided(spark):
    made = marketplace(spark)
    made["order_reviews"] = made["order_reviews"].where("order_id = 'o2'")
    row = logistics.delay_vs_review(Model(made)).first()
    assert row["on_time_mean_review"] == 5.0 and row["delayed_mean_review"] is None and row["review_gap_points"] is None
    assert logistics.review_boxes(Model(made)).count() == 0


def test_identities(spark):
    import __spark_entry__ as contract
    from conftest import DATA

    model = contract.model(spark, f"{DATA}/sf0.01").with_orders_kept
    from bazaarlens.plans import growth

    metrics = monthly.monthly_metrics(model)
    totals = model.order_core.agg(F.sum("order_revenue"), F.count("*"), F.countDistinct("customer_id")).first()
    state = growth.concentration_state(model).agg(F.sum("item_revenue"), F.max("cum_share"), F.max("rank"), F.count("*")).first()
    assert state[0] == pytest.approx(totals[0]) and state[1] == pytest.approx(1.0) and state[2] == state[3]
    everyone = model.customer_month.agg(F.count_if("holds_first_order")).first()[0]
    assert everyone == totals[2]
    assert metrics.agg(F.sum("orders_month")).first()[0] <= totals[1]
    again = repurchase.repurchase_categories(model).agg(F.sum("item_revenue")).first()[0]
    assert again == pytest.approx(repurchase.repurchase_kpis(model).first()["revenue_repurchase_customers"])


def test_headline_figures_make_no_rows(spark, monkeypatch, capsys):
    """No copy of the orders that kpi_summary writes multiplies the items, as distinct counts do."""
    import __spark_entry__ as contract
    from bazaarlens.plans import model as module, report
    from conftest import DATA

    plans, write = [], module.cut_lineage

    def kept(df):
        df.explain()
        plans.append(capsys.readouterr().out)
        return write(df)

    monkeypatch.setattr(module, "cut_lineage", kept)
    report.kpi_summary(contract.model(spark, f"{DATA}/sf0.001"))
    assert plans and not any("Expand" in plan for plan in plans)
