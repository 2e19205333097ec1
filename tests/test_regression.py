"""Fits against numpy, exact rank tests against enumeration."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarlens.functions import tails
from bazaarlens.operators import hypothesis, regression


def _by_numpy(x, y):
    design = np.column_stack([np.ones(len(x)), x])
    back = np.linalg.pinv(design, rcond=1e-9)
    beta = back @ y
    freedom = len(y) - np.linalg.matrix_rank(design, tol=1e-9 * np.linalg.norm(design))
    left = ((y - design @ beta) ** 2).sum()
    return beta, np.sqrt(np.diag(back @ back.T) * left / freedom), 1 - left / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize("case", ["plain", "shifted", "constant", "sum", "twice"])
def test_ols_as_the_pseudo_inverse(spark, case):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) * [1.0, 5.0, 0.1]
    if case == "shifted":
        x += [1e3, -50, 7]
    elif case == "constant":
        x[:, 1] = 100.0
    elif case == "sum":
        x[:, 2] = x[:, 0] + 2 * x[:, 1]
    elif case == "twice":
        x[:, 1] = x[:, 0]
    y = 3 + x @ [2.0, -1.0, 0.5] + rng.normal(size=60)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, y double")
    fit = {r["term"]: r for r in regression.ols(df, "y", ["a", "b", "c"]).collect()}
    beta, errors, r2 = _by_numpy(x, y)
    for k, term in enumerate(["const", "a", "b", "c"]):
        assert fit[term]["coef"] == pytest.approx(beta[k], rel=1e-6, abs=1e-9)
        assert fit[term]["stderr"] == pytest.approx(errors[k], rel=1e-6)
        assert fit[term]["r_squared"] == pytest.approx(r2, rel=1e-9) and fit[term]["n_obs"] == 60


def test_ols_needs_rows_and_a_target_that_varies(spark):
    rows = [(float(i), float(i * i), 1.0) for i in range(6)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    assert regression.ols(df.limit(4), "y", ["a", "b"]).count() == 0
    assert regression.ols(df.limit(0), "y", ["a"]).count() == 0
    flat = regression.ols(df, "y", ["a", "b"]).first()
    assert flat["r_squared"] is None and flat["adj_r_squared"] is None


def test_large_means_cost_no_digits(spark):
    rows = [(1e9 + i, 3.0 * i + (i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, y double")
    fit = {r["term"]: r for r in regression.ols(df, "y", ["a"]).collect()}
    slope = np.polyfit(np.arange(200.0), [y for _, y in rows], 1)[0]
    assert fit["a"]["coef"] == pytest.approx(slope, rel=1e-7)


def _newton(x, y):
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        information = design.T @ (design * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(information, design.T @ (y - p))
    p = 1 / (1 + np.exp(-design @ beta))
    return beta, np.sqrt(np.linalg.inv(information)[1, 1]), (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()


def test_logit_as_newton(spark):
    rng = random.Random(5)
    rows = [(float(rng.random() < 0.2 + 0.06 * (i % 10)), 1000.0 + i % 10) for i in range(400)] + [(None, 1.0), (1.0, None)]
    fit = regression.logit(spark.createDataFrame(rows, "y double, x double"), "y", "x").first()
    y, x = np.array([r[0] for r in rows[:400]]), np.array([r[1] for r in rows[:400]])
    beta, error, likelihood = _newton(x - 1000, y)
    null = y.sum() * math.log(y.mean()) + (400 - y.sum()) * math.log(1 - y.mean())
    assert (fit["status"], fit["n_obs"], fit["events"]) == ("ok", 400, int(y.sum()))
    assert fit["coef"] == pytest.approx(beta[1], rel=1e-8) and fit["odds_ratio"] == pytest.approx(math.exp(beta[1]), rel=1e-8)
    assert fit["pvalue"] == pytest.approx(math.erfc(abs(beta[1]) / error / math.sqrt(2)), rel=1e-7)
    assert fit["pseudo_r2"] == pytest.approx(1 - likelihood / null, rel=1e-8)


@pytest.mark.parametrize(
    "rows, status",
    [
        ([(0.0, 1.0), (0.0, 2.0)], "insufficient_variance"),
        ([], "insufficient_variance"),
        ([(float(i > 9), float(i)) for i in range(20)], "failed"),
        ([(float(i > 9), -float(i)) for i in range(20)], "failed"),
        ([(float(i > 9), float(i)) for i in range(20)] + [(1.0, 9.0)], "failed"),  # the classes touch in one value
        ([(float(i % 2), 4.0) for i in range(20)], "failed"),  # the feature never varies
        ([(float(i > 9), float(i)) for i in range(20)] + [(1.0, 3.0)], "ok"),
    ],
)
def test_logit_status(spark, rows, status):
    df = spark.createDataFrame(rows, "y double, x double")
    assert regression.logit(df, "y", "x").first()["status"] == status


def test_separated_along_two_features(spark):
    """No feature alone splits the classes, their sum does: the steps end without a fit."""
    rows = [(float(a + b > 0), float(a), float(b), 1) for a in range(-4, 5) for b in range(-4, 5) if a + b]
    df = spark.createDataFrame(rows, "y double, x0 double, x1 double, weight long")
    assert regression.fit_logit(df, 2) is None


def test_exact_mann_whitney():
    for n_a, n_b in ((1, 1), (2, 3), (3, 7), (4, 4), (8, 5)):
        sizes = [sum(1 for i, a in enumerate(places) for b in range(a) if b not in places) for places in itertools.combinations(range(n_a + n_b), n_a)]
        for u in range(n_a * n_b + 1):
            high = max(u, n_a * n_b - u)
            wanted = min(1.0, 2 * sum(s >= high for s in sizes) / len(sizes))
            assert tails.mann_whitney_exact(u, n_a, n_b) == pytest.approx(wanted, rel=1e-12), (u, n_a, n_b)


def test_exact_mann_whitney_of_many(monkeypatch):
    """The limit as a sum of uniform numbers agrees with the exact numbers."""
    pairs = [(u, m, 3000) for m in (1, 2, 5, 8) for u in (3000 * m // 7, 3000 * m // 3, 3000 * m // 2)]
    exact = [tails.mann_whitney_exact(*p) for p in pairs]
    monkeypatch.setattr(tails, "EXACT_STATES", 0)
    assert [tails.mann_whitney_exact(*p) for p in pairs] == pytest.approx(exact, rel=1e-4)


def test_two_groups_small_and_tied(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 4, 6)] + [("b", float(v)) for v in (2, 3, 5, 7, 8)], "g string, x double")
    exact = hypothesis.two_group_tests(df, "x", F.col("g") == "a", "demo").first()
    assert exact["mannwhitney_pvalue"] == pytest.approx(tails.mann_whitney_exact(5, 3, 5))
    tied = df.union(spark.createDataFrame([("a", 8.0)], "g string, x double"))
    normal = hypothesis.two_group_tests(tied, "x", F.col("g") == "a", "demo").first()
    z = hypothesis.mann_whitney(tied, "x", F.col("g") == "a").first()["z_statistic"]
    assert normal["mannwhitney_pvalue"] == pytest.approx(tails.normal_pvalue(z))
    constant = df.withColumn("x", F.lit(2.0))
    row = hypothesis.two_group_tests(constant, "x", F.col("g") == "a", "demo").first()
    assert row["ttest_pvalue"] is None
