"""Least squares and logistic regression from sums that Spark aggregates.

Rows never leave the executors: a fit sees counts, means and cross products of at
most (features + 1)^2 numbers, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Row, functions as F

from bazaarlens.functions.tails import normal_pvalue, student_pvalue
from bazaarlens.session import cut_lineage

# A column is collinear if less than this share of its variance is left beside the others.
COLLINEAR = 1e-10
# Newton steps of a logit, and the size (in standard deviations of the features) below which the last one ends it.
MOST_STEPS = 35
LAST_STEP = 1e-9

OLS_SCHEMA = (
    "term string, coef double, pvalue double, stderr double, tvalue double, "
    "r_squared double, adj_r_squared double, n_obs bigint"
)
LOGIT_SCHEMA = (
    "status string, n_obs bigint, events bigint, coef double, pvalue double, odds_ratio double, pseudo_r2 double"
)


def complete_rows(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Target as ``y`` and features as ``x0``, ``x1``, ...; rows with a null or NaN are gone."""
    return df.select(
        F.col(target).cast("double").alias("y"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    ).dropna()


@dataclass(frozen=True)
class Moments:
    """Rows, means and centred cross products of x0, x1, ... and y (last)."""

    n: int
    means: np.ndarray
    products: np.ndarray


def moments(rows: DataFrame, features: int) -> Moments:
    """All moments in one aggregate. Spark merges centred sums, so large means cost no digits."""
    names = [*[f"x{i}" for i in range(features)], "y"]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    found = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(name) for name in names]).alias("means"),
        F.array(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).alias("covariances"),
    ).first()
    products = np.zeros((len(names), len(names)))
    if found["n"]:
        for (i, j), value in zip(pairs, found["covariances"]):
            products[i, j] = products[j, i] = value * found["n"]
    return Moments(found["n"], np.array([m or 0.0 for m in found["means"]]), products)


def independent_columns(products: np.ndarray) -> list[int]:
    """Columns found independent by a Cholesky decomposition that takes the largest remaining share of variance first.

    The rank is their number. A column that hardly varies beside those taken already is left out.
    """
    size = np.sqrt(np.diag(products))
    varies = [i for i in range(len(size)) if size[i] > 0]
    scale = np.where(size > 0, size, 1.0)
    rest = products / np.outer(scale, scale)
    taken: list[int] = []
    while open_ := [i for i in varies if i not in taken]:
        best = max(open_, key=lambda i: (rest[i, i], -i))
        if rest[best, best] <= COLLINEAR:
            break
        rest = rest - np.outer(rest[:, best], rest[best]) / rest[best, best]
        taken.append(best)
    return sorted(taken)


def least_squares(found: Moments, features: Sequence[str]) -> list[Row]:
    """A row for each feature and the constant.

    Collinear columns share their effect as the solution of least length does (the pseudo-inverse): with A the
    constant and the independent columns, X = A C, and pinv(X) = pinv(C) pinv(A).
    """
    p = len(features)
    kept = independent_columns(found.products[:p, :p])
    inner = found.products[np.ix_(kept, kept)]
    inverse = np.linalg.inv(inner) if kept else np.zeros((0, 0))
    slopes = inverse @ found.products[kept, p]
    means = found.means[kept]
    # (A'A)^-1 with the constant first, in the units of the columns.
    spread = np.zeros((len(kept) + 1, len(kept) + 1))
    spread[0, 0] = 1.0 / found.n + means @ inverse @ means
    spread[0, 1:] = spread[1:, 0] = -inverse @ means
    spread[1:, 1:] = inverse
    solution = np.append(found.means[p] - slopes @ means, slopes)
    combine = np.zeros((len(kept) + 1, p + 1))  # C, the constant's column first
    combine[0, 0] = 1.0
    for k in range(p):
        if k in kept:
            combine[1 + kept.index(k), 1 + k] = 1.0
        else:
            along = inverse @ found.products[kept, k]
            combine[1:, 1 + k] = along
            combine[0, 1 + k] = found.means[k] - along @ means
    back = np.linalg.pinv(combine)
    coefficients, spread = back @ solution, back @ spread @ back.T
    total = found.products[p, p]
    left = float(max(total - slopes @ found.products[kept, p], 0.0))
    freedom = found.n - len(kept) - 1
    r2 = float(1.0 - left / total) if total > 0 else None
    adjusted = None if r2 is None else 1.0 - (1.0 - r2) * (found.n - 1) / freedom
    rows = []
    for k, term in enumerate(["const", *features]):
        error = math.sqrt(max(spread[k, k], 0.0) * left / freedom)
        t = float(coefficients[k]) / error if error > 0 else None
        rows.append((term, float(coefficients[k]), student_pvalue(t, freedom), error, t, r2, adjusted, found.n))
    return rows


def ols(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Least squares with intercept: one row per term. No row when there are not
    at least three more observations than features. Runs at once, in one job."""
    found = moments(complete_rows(df, target, features), len(features))
    rows = least_squares(found, features) if found.n >= len(features) + 3 else []
    return df.sparkSession.createDataFrame(rows, OLS_SCHEMA)


def _likelihood(rows: DataFrame, beta: np.ndarray, means: np.ndarray, size: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and information at ``beta`` (constant first), in one aggregate."""
    design = [F.lit(1.0), *[(F.col(f"x{i}") - float(m)) / float(s) for i, (m, s) in enumerate(zip(means, size))]]
    line = sum((x * float(b) for x, b in zip(design[1:], beta[1:])), F.lit(float(beta[0])))
    known = rows.select(*[x.alias(f"d{i}") for i, x in enumerate(design)], line.alias("line"), "y", "weight")
    p = 1.0 / (1.0 + F.exp(-F.col("line")))
    w = F.col("weight").cast("double")
    # log(1 + e^line) without overflow.
    softplus = F.greatest("line", F.lit(0.0)) + F.log1p(F.exp(-F.abs("line")))
    k = len(design)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def total(value: Column) -> Column:
        return F.sum(w * value)

    got = known.agg(
        total(F.col("y") * F.col("line") - softplus).alias("likelihood"),
        F.array(*[total((F.col("y") - p) * F.col(f"d{i}")) for i in range(k)]).alias("gradient"),
        F.array(*[total(p * (1.0 - p) * F.col(f"d{i}") * F.col(f"d{j}")) for i, j in pairs]).alias("information"),
    ).first()
    information = np.zeros((k, k))
    for (i, j), value in zip(pairs, got["information"]):
        information[i, j] = information[j, i] = value
    return got["likelihood"], np.array(got["gradient"]), information


def _separated(rows: DataFrame, features: int) -> bool:
    """Whether one feature alone splits the two classes (touching at most in one value): no finite fit exists."""
    y = F.col("y") > 0
    ends = rows.agg(*[
        end(F.when(side, F.col(f"x{i}"))).alias(f"{name}{i}")
        for i in range(features) for name, end, side in (
            ("least_event", F.min, y), ("most_event", F.max, y), ("least_other", F.min, ~y), ("most_other", F.max, ~y)
        )
    ]).first()
    return any(
        ends[f"most_other{i}"] <= ends[f"least_event{i}"] or ends[f"most_event{i}"] <= ends[f"least_other{i}"]
        for i in range(features)
    )


def fit_logit(rows: DataFrame, features: int) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Coefficients (constant first), their covariance and the log-likelihood; None without a finite, unique fit.

    Newton steps on scaled features; ``rows`` has y (0 or 1), x0, x1, ... and weight. A direction in which the classes
    are separated makes the steps go on without an end, and the information singular.
    """
    spread = rows.agg(
        F.sum("weight").alias("n"),
        *[(F.sum(F.col("weight") * F.col(f"x{i}")) / F.sum("weight")).alias(f"mean{i}") for i in range(features)],
    ).first()
    means = np.array([spread[f"mean{i}"] for i in range(features)])
    second = rows.agg(*[
        (F.sum(F.col("weight") * (F.col(f"x{i}") - float(m)) ** 2) / F.sum("weight")).alias(f"v{i}") for i, m in enumerate(means)
    ]).first()
    size = np.sqrt(np.array(list(second)))
    if (size <= 0).any() or _separated(rows, features):
        return None
    beta = np.zeros(features + 1)
    for _ in range(MOST_STEPS):
        likelihood, gradient, information = _likelihood(rows, beta, means, size)
        scale = np.sqrt(np.diag(information))
        if (scale <= 0).any() or len(independent_columns(information)) < len(beta):
            return None
        step = np.linalg.solve(information, gradient)
        beta = beta + step
        if np.abs(step).max() < LAST_STEP:
            # Back to the units of the features: b = b_scaled / size, the constant moves by the means.
            turn = np.zeros((features + 1, features + 1))
            turn[0, 0], turn[0, 1:] = 1.0, -means / size
            turn[1:, 1:] = np.diag(1.0 / size)
            return turn @ beta, turn @ np.linalg.inv(information) @ turn.T, likelihood
        if np.abs(beta).max() > 1e6:
            return None
    return None


def logit(df: DataFrame, target: str, feature: str) -> DataFrame:
    """Logistic regression of a 0/1 target on one feature: one row.

    ``failed`` stands for separated classes, a constant feature, or steps that do not converge. Equal rows are
    counted first, so hot values cost one row in every step."""
    counted = cut_lineage(complete_rows(df, target, [feature]).groupBy("y", "x0").agg(F.count(F.lit(1)).alias("weight")))
    facts = counted.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("weight") * F.col("y")), F.lit(0.0)).alias("events")).first()
    n, events = facts["n"], int(facts["events"])
    nothing = (None, None, None, None)
    if events in (0, n):
        row = ("insufficient_variance", n, events, *nothing)
    elif (fitted := fit_logit(counted, 1)) is None:
        row = ("failed", n, events, *nothing)
    else:
        beta, covariance, likelihood = fitted
        null = events * math.log(events / n) + (n - events) * math.log(1 - events / n)
        z = abs(beta[1]) / math.sqrt(covariance[1, 1])
        row = ("ok", n, events, float(beta[1]), normal_pvalue(float(z)), math.exp(beta[1]), 1.0 - likelihood / null)
    return df.sparkSession.createDataFrame([row], LOGIT_SCHEMA)
