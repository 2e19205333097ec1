"""What the physical plans must and must not contain."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as contract
from bazaarlens import catalog
from conftest import DATA


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as text:
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def model(spark):
    return contract.model(spark, f"{DATA}/sf0.001")


NAMES = ["order_level", "item_fact", "monthly_metrics", "monthly_repurchase", "seller_risk", "repurchase_categories",
         "m06_average_ticket", "m30_returning_customers_by_category", "m35_items_of_recurring_customers_by_category",
         "m38_revenue_trend", "m45_strategic_revenue_share", "m50_projected_3_months"]


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_join_and_no_python(model, name):
    text = plan(catalog.QUERIES[name](model))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"PythonUDF|ArrowEvalPython|BatchEvalPython|MapInPandas", text)


def test_scan_reads_needed_columns_only(model):
    text = plan(catalog.QUERIES["m59_product_revenue"](model))
    reads = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert {"l_orderkey:bigint,l_extendedprice:double", "o_orderkey:bigint,o_orderdate:timestamp_ntz"} == set(reads)


def test_unused_distinct_counts_are_pruned(model):
    text = plan(catalog.QUERIES["monthly_metrics"](model))
    assert "Expand" not in text
    # ship dates and prices; no scan for the seller and product counts
    assert len(re.findall(r"Location: InMemoryFileIndex \[file:[^]]*lineitem", text)) == 2


def test_order_sales_scan_items_once(model):
    text = plan(model.order_sales)
    assert len(re.findall(r"Location: InMemoryFileIndex \[file:[^]]*lineitem", text)) == 1


def test_top_n_is_cut_before_the_shuffle(model):
    assert "WindowGroupLimit" in plan(catalog.QUERIES["m60_strategic_revenue"](model))
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["top_detractors"](model))
