"""Every analysis and measure with a SQL twin must agree with it on the smallest tables."""

import pytest

import __spark_entry__ as contract
import compare
from bazaarlens import catalog
from conftest import DATA

FOLDER = f"{DATA}/sf0.001"
QUERIES = {name: query for name, query in contract.queries().items() if name in catalog.QUERIES}
TWINS = {name: sql for name, sql in contract.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", list(TWINS))
def test_twin(spark, duck, name):
    assert compare.differences(QUERIES[name](spark, FOLDER), duck, TWINS[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in TWINS])
def test_without_twin_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
