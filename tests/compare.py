"""Order-insensitive comparison of a Spark result with its SQL twin."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return repr(float(value) + 0.0)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql) -> str | None:
    names, rows = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    oracle_names, oracle_rows = table([c[0] for c in result.description], result.fetchall())
    if names != oracle_names:
        return f"columns {names} vs {oracle_names}"
    if len(rows) != len(oracle_rows):
        return f"rows {len(rows)} vs {len(oracle_rows)}"
    wrong = [(a, b) for a, b in zip(rows, oracle_rows) if a != b]
    if wrong:
        shown = [(n, x, y) for n, x, y in zip(names, *wrong[0]) if x != y]
        return f"{len(wrong)} of {len(rows)} rows differ, first: {shown[:4]}"
    return None
