"""Two-sided tail probabilities for one-row test results."""

from __future__ import annotations

import math

import numpy as np


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return value
    raise ArithmeticError(f"incomplete beta function of {a}, {b}, {x} has not converged")


def regularized_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


# Beyond it the normal expansion agrees with the beta function to the last digits, and the fraction gets slow.
EXPANSION_DF = 10_000


def _student_deviate(t: float, df: float) -> float:
    """The normal deviate with the tail of ``t``: Hill's expansion (1970) in the inverse of the degrees of freedom."""
    a = df - 0.5
    b = 48.0 * a * a
    z2 = a * math.log1p(t * t / df)
    correction = (((-0.4 * z2 - 3.3) * z2 - 24.0) * z2 - 85.5) / (0.8 * z2 * z2 + 100.0 + b)
    return ((correction + z2 + 3.0) / b + 1.0) * math.sqrt(z2)


def student_two_sided(t: float, df: float) -> float:
    if df > EXPANSION_DF:
        return normal_two_sided(_student_deviate(t, df))
    return regularized_beta(df / 2.0, 0.5, df / (df + t * t))


def student_pvalue(t: float | None, df: float | None) -> float | None:
    if t is None or df is None or math.isnan(t) or df <= 0:
        return None
    return student_two_sided(t, df)


def normal_pvalue(z: float | None) -> float | None:
    """Two-sided p of a z that is not negative; a z below zero can only come from
    the continuity correction and gives 1."""
    return None if z is None or math.isnan(z) else normal_two_sided(max(z, 0.0))


# Beyond so many values U is taken as a sum of uniform numbers of the same mean and variance, which is then true to many digits.
EXACT_STATES = 20_000_000


def mann_whitney_exact(u: int, n_a: int, n_b: int) -> float:
    """Two-sided p of U without ties: twice the smaller tail, at most 1.

    The numbers of orders with U = 0, 1, ... are the coefficients of the Gaussian
    binomial of n_a + n_b over the smaller size m, built as the product of
    (1 - q^(n + i)) / (1 - q^i) for i up to m, scaled to probabilities on the way.
    """
    m, n = sorted((n_a, n_b))
    low = min(u, n_a * n_b - u)
    if low + 1 > EXACT_STATES:
        x = (low + 0.5 - m * n / 2) / math.sqrt(n * (m + n + 1)) + m / 2
        below = sum((-1) ** k * math.comb(m, k) * (x - k) ** m for k in range(int(x) + 1)) / math.factorial(m)
        return min(1.0, 2.0 * below)
    chance = np.zeros(low + 1)
    chance[0] = 1.0
    for i in range(1, m + 1):
        if n + i <= low:
            chance[n + i :] -= chance[: -(n + i)].copy()
        for start in range(min(i, low + 1)):
            chance[start::i] = np.cumsum(chance[start::i])
        chance *= i / (n + i)
    return min(1.0, 2.0 * float(chance.sum()))
