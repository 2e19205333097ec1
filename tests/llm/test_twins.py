"""Queries with a SQL twin must agree with it on the smallest tables."""

import duckdb
import pytest

import compare
from bazaarlens.llm.oracle import ORACLES
from bazaarlens.llm.queries import QUERIES
from conftest import DATA

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", list(ORACLES))
def test_twin(spark, duck, name):
    assert compare.differences(QUERIES[name](spark, FOLDER), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
