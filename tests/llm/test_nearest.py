"""Nearest neighbours against brute force, with hot vectors and edge cases."""

import math

import numpy as np
from pyspark.sql import functions as F

from bazaarlens.llm import nearest as nn


def brute(rows, most=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, v in good:
        if q % 10 == 0:
            near = sorted((math.sqrt(((v - w) ** 2).sum()), i) for i, w in good if i != q and len(v) == len(w))
            out[q] = [i for _, i in near[:most]]
    return out


def found(df):
    out = {}
    for r in sorted(nn.nearest(df, F.col("vec_id") % 10 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nn, "VECTOR_BLOCK", 100)
    monkeypatch.setattr(nn, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-40, 40, 24).astype(float).tolist()) for i in range(600)]
    hot = rows[7][1]
    rows += [(600 + i, hot) for i in range(300)]
    rows += [(910, None), (911, [0.0] * 24), (912, [float("nan")] * 24), (913, [None] * 24), (None, hot), (920, [1.0, 2.0]), (921, [1.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumn("size", F.lit(1)).repartition(6)
    expected = brute(rows)
    got = found(df)
    assert got == expected and got[920] == [921]
    assert nn.nearest(df.limit(0), F.lit(True)).count() == 0
    assert nn.nearest(df, F.lit(False)).count() == 0


def test_repeated_queries(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 31)] + [(10, [10.0, 1.0])] * 2 + [(20, [-50.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = nn.nearest(df, F.col("vec_id") % 10 == 0).collect()
    by = {q: [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (10, 20, 30)}
    assert by[10] == [(k + 1, i) for k, i in enumerate([9, 11, 8, 12, 7, 13, 6, 14, 5, 15])]
    # The smallest of the two vectors of 20 asks.
    assert by[20] == [(k, k) for k in range(1, 10)] + [(10, 10)]
    # Each row is a candidate of its own.
    assert [i for _, i in by[30]] == [29, 28, 27, 26, 25, 24, 23, 22, 21, 20]


def test_estimates_hold():
    rng = np.random.default_rng(9)
    vectors, queries = rng.standard_normal((400, 64)), rng.standard_normal((20, 64))
    centre = vectors.mean(axis=0)
    squared, error = nn.estimate(*nn.codes_of(vectors, centre), queries, centre)
    exact = ((queries[:, None] - vectors[None]) ** 2).sum(axis=2)
    assert (np.abs(exact - squared) <= error).all()
    assert np.abs(exact - squared).mean() < 0.15 * exact.mean()
