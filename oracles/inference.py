"""SQL twins of tests and regressions: tails as series, least squares in closed form, logit by recursive Newton steps."""

from __future__ import annotations

DRIVERS = ("late_rate_pct", "repurchase_customer_rate_pct", "strategic_revenue_share_pct")
SCENARIO = (-3.0, 3.0, 3.0)


def student_p(t: str, df: str) -> str:
    """Two-sided tail: one minus the incomplete beta function of 1/2 and df/2 at t^2 / (df + t^2), by its power series."""
    x, b = f"(({t}) * ({t}) / ({df} + ({t}) * ({t})))", f"({df} / 2)"
    terms = f"sum(exp(lgamma(0.5 + {b} + k) - lgamma(0.5 + {b}) - lgamma(1.5 + k) + lgamma(1.5::DOUBLE) + k * ln({x})))"
    front = f"exp(0.5 * ln({x}) + {b} * ln(1 - {x}) + lgamma(0.5 + {b}) - lgamma(0.5::DOUBLE) - lgamma({b})) * 2"
    return f"CASE WHEN ({t}) = 0 THEN 1.0::DOUBLE ELSE 1 - {front} * (SELECT {terms} FROM range(4000) AS r(k)) END"


def normal_p(z: str) -> str:
    """Two-sided tail of z above zero: the error function's series over odd double factorials."""
    terms = f"sum(exp((2 * k + 1) * ln({z}) - (k + 1) * ln(2.0::DOUBLE) - lgamma(k + 1.5::DOUBLE) + 0.5 * ln(pi())))"
    series = f"sqrt(2 / pi()) * exp(-({z}) * ({z}) / 2) * (SELECT {terms} FROM range(1500) AS r(k))"
    return f"CASE WHEN ({z}) <= 0 THEN 1.0::DOUBLE ELSE 1 - {series} END"


def _groups(source: str, value: str, flag: str) -> str:
    """n_a, n_b, means, t, df and z of two groups, unrounded."""
    return f"""
means AS (
  SELECT *, (ma - mb) / sqrt(va / na + vb / nb) AS t,
    pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df
  FROM (SELECT count(*) FILTER (WHERE {flag}) AS na, count(*) FILTER (WHERE NOT {flag}) AS nb,
      avg({value}) FILTER (WHERE {flag}) AS ma, avg({value}) FILTER (WHERE NOT {flag}) AS mb,
      var_samp({value}) FILTER (WHERE {flag}) AS va, var_samp({value}) FILTER (WHERE NOT {flag}) AS vb FROM {source})
), placed AS (
  SELECT {flag} AS f, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS rk,
    count(*) OVER (PARTITION BY v) AS ties
  FROM (SELECT *, round({value}, 9) AS v FROM {source})
), rank_sums AS (
  SELECT sum(rk) FILTER (WHERE f) AS ra, sum((CAST(ties AS DOUBLE) * ties * ties - ties) / ties) AS tied FROM placed
), scores AS (
  SELECT na, nb, ma, mb, t, df, ra - na * (na + 1) / 2.0::DOUBLE AS u,
    sqrt(na * nb / 12.0::DOUBLE * (na + nb + 1 - tied / ((na + nb) * (na + nb - 1.0::DOUBLE)))) AS sd FROM means, rank_sums
), tested AS (
  SELECT *, (greatest(u, na * nb - u) - na * nb / 2.0::DOUBLE - 0.5) / sd AS z FROM scores
)"""


def two_groups(label: str, source: str, value: str, flag: str) -> str:
    return f"""WITH {_groups(source, value, flag).strip()}
SELECT '{label}' AS label, na AS n_group_a, nb AS n_group_b, round(ma, 6) AS mean_group_a, round(mb, 6) AS mean_group_b,
  round({student_p('t', 'df')}, 6) AS ttest_pvalue, round({normal_p('z')}, 6) AS mannwhitney_pvalue,
  least(na, nb) < 20 AS small_sample
FROM tested"""


_SPEARMAN = """
spearman AS (
  SELECT n, rho, rho * sqrt((n - 2) / (1 - rho * rho)) AS st FROM (SELECT count(*) AS n, corr(rx, ry) AS rho FROM (
    SELECT rank() OVER (ORDER BY delay_days) + (count(*) OVER (PARTITION BY delay_days) - 1) / 2.0::DOUBLE AS rx,
      rank() OVER (ORDER BY review_score) + (count(*) OVER (PARTITION BY review_score) - 1) / 2.0::DOUBLE AS ry
    FROM reviewed))
)"""


def _text_p(p: str) -> str:
    return (
        f"CASE WHEN {p} < 0.001 THEN '<0,001' ELSE translate(format('{{:.4f}}', CAST({p} AS DOUBLE)), '.', ',') END"
    )


_FIT = f"""
complete AS (
  SELECT growth AS y, {', '.join(f'{d} AS x{i}' for i, d in enumerate(DRIVERS, 1))} FROM drivers
  WHERE growth IS NOT NULL AND {' AND '.join(f'{d} IS NOT NULL' for d in DRIVERS)}
), sums AS (
  SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, var_pop(y) * count(*) AS yy,
    var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22, var_pop(x3) * count(*) AS s33,
    covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, x3) * count(*) AS s13, covar_pop(x2, x3) * count(*) AS s23,
    covar_pop(x1, y) * count(*) AS c1, covar_pop(x2, y) * count(*) AS c2, covar_pop(x3, y) * count(*) AS c3
  FROM complete
), cofactors AS (
  -- A third driver that never varies shares the constant's effect; the rest is a fit on two.
  SELECT *, s33 = 0 AS flat, CASE WHEN s33 = 0 THEN s22 ELSE s22 * s33 - s23 * s23 END AS a11,
    CASE WHEN s33 = 0 THEN -s12 ELSE s13 * s23 - s12 * s33 END AS a12, CASE WHEN s33 = 0 THEN 0 ELSE s12 * s23 - s13 * s22 END AS a13,
    CASE WHEN s33 = 0 THEN s11 ELSE s11 * s33 - s13 * s13 END AS a22, CASE WHEN s33 = 0 THEN 0 ELSE s12 * s13 - s11 * s23 END AS a23,
    CASE WHEN s33 = 0 THEN 0 ELSE s11 * s22 - s12 * s12 END AS a33 FROM sums
), solved AS (
  SELECT *, s11 * a11 + s12 * a12 + s13 * a13 AS det FROM cofactors
), slopes AS (
  SELECT *, (a11 * c1 + a12 * c2 + a13 * c3) / det AS b1, (a12 * c1 + a22 * c2 + a23 * c3) / det AS b2,
    (a13 * c1 + a23 * c2 + a33 * c3) / det AS w3 FROM solved
), constants AS (
  SELECT *, my - b1 * m1 - b2 * m2 - w3 * m3 AS w0, yy - b1 * c1 - b2 * c2 - w3 * c3 AS ssr, n - CASE WHEN flat THEN 3 ELSE 4 END AS df,
    1.0 / n + (m1 * m1 * a11 + m2 * m2 * a22 + m3 * m3 * a33 + 2 * (m1 * m2 * a12 + m1 * m3 * a13 + m2 * m3 * a23)) / det AS w00
  FROM slopes WHERE n >= 6
), fitted AS (
  SELECT *, CASE WHEN flat THEN w0 / (1 + m3 * m3) ELSE w0 END AS b0, CASE WHEN flat THEN m3 * w0 / (1 + m3 * m3) ELSE w3 END AS b3,
    CASE WHEN flat THEN w00 / pow(1 + m3 * m3, 2) ELSE w00 END AS v0, a11 / det AS v1, a22 / det AS v2,
    CASE WHEN flat THEN m3 * m3 * w00 / pow(1 + m3 * m3, 2) ELSE a33 / det END AS v3 FROM constants
)"""

_OLS = f"""WITH {_FIT.strip()}, terms AS (
  SELECT 'const' AS term, b0 AS b, v0 AS v, n, ssr, yy, df FROM fitted
  {' '.join(f"UNION ALL SELECT '{d}', b{i}, v{i}, n, ssr, yy, df FROM fitted" for i, d in enumerate(DRIVERS, 1))}
), errors AS (
  SELECT * EXCLUDE (df), CAST(df AS DOUBLE) AS df, sqrt(v * ssr / df) AS se, 1 - ssr / yy AS r2 FROM terms
), ratios AS (SELECT *, b / se AS t FROM errors)
SELECT term, round(b, 6) AS coef, round({student_p('t', 'df')}, 6) AS pvalue, round(se, 6) AS stderr, round(t, 6) AS tvalue,
  round(r2, 6) AS r_squared, round(1 - (1 - r2) * (n - 1) / df, 6) AS adj_r_squared, n AS n_obs
FROM ratios"""

_LINE = " + ".join(["b0", *[f"b{i} * {d}" for i, d in enumerate(DRIVERS, 1)]])
_CHANGE = " + ".join(f"b{i} * ({delta})" for i, delta in enumerate(SCENARIO, 1))

_OUTPUT = f"""WITH {_FIT.strip()}, lines AS (SELECT d.*, {_LINE} AS line FROM drivers AS d LEFT JOIN fitted ON TRUE)
SELECT year_month AS ano_mes, round(revenue_month, 2) AS receita_mes, round(growth, 6) AS crescimento_receita_m1_pct,
  CASE WHEN growth IS NOT NULL THEN round(least(greatest(growth, (SELECT quantile_cont(growth, 0.05) FROM drivers)),
    (SELECT quantile_cont(growth, 0.95) FROM drivers)), 6) END AS crescimento_receita_m1_pct_ajustado,
  round(late_rate_pct, 6) AS percentual_pedidos_atrasados,
  round(repurchase_customer_rate_pct, 6) AS percentual_clientes_com_recompra,
  round(strategic_revenue_share_pct, 6) AS percentual_receita_sellers_estrategicos,
  round(line, 6) AS baseline_crescimento_m1_pct, round(revenue_month * (1 + line / 100), 2) AS baseline_receita_m1,
  round(next_month_revenue, 2) AS receita_m1_observada, next_month_label AS ano_mes_m1
FROM lines"""

_SCENARIO = f"""WITH {_FIT.strip()}, lines AS (
  SELECT d.*, {_LINE} AS line, {_CHANGE} AS change FROM drivers AS d LEFT JOIN fitted ON TRUE)
SELECT year_month, round(revenue_month, 2) AS revenue_month, round(line, 6) AS predicted_growth_m1_pct,
  round(revenue_month * (1 + line / 100), 2) AS baseline_revenue_m1, round(line + change, 6) AS scenario_growth_m1_pct,
  round(revenue_month * (1 + (line + change) / 100), 2) AS scenario_revenue_m1
FROM lines ORDER BY month DESC LIMIT 1"""

_LOGIT = f"""WITH flagged AS (
  SELECT CASE WHEN review_score <= (SELECT t FROM threshold) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, delay_days AS x
  FROM reviewed WHERE delay_days IS NOT NULL
), facts AS (
  SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS events, avg(x) AS m, stddev_pop(x) AS s FROM flagged
), scaled AS (
  SELECT y, (x - m) / s AS d, CAST(count(*) AS DOUBLE) AS w FROM flagged, facts GROUP BY ALL
), newton(k, a, b) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT k + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (SELECT k, a, b, sum(w * (y - p)) AS g0, sum(w * (y - p) * d) AS g1, sum(w * p * (1 - p)) AS h00,
      sum(w * p * (1 - p) * d) AS h01, sum(w * p * (1 - p) * d * d) AS h11
    FROM (SELECT *, 1 / (1 + exp(-(a + b * d))) AS p FROM newton, scaled WHERE k < 20) GROUP BY k, a, b)
), ended AS (
  SELECT b, sum(w * (y * ln(p) + (1 - y) * ln(1 - p))) AS likelihood, sum(w * p * (1 - p)) AS h00,
    sum(w * p * (1 - p) * d) AS h01, sum(w * p * (1 - p) * d * d) AS h11
  FROM (SELECT *, 1 / (1 + exp(-(a + b * d))) AS p FROM newton, scaled WHERE k = 20) GROUP BY b
), scored AS (
  SELECT n, events, b / s AS coef, likelihood, abs(b) / sqrt(h00 / (h00 * h11 - h01 * h01)) AS z,
    events * ln(events / n) + (n - events) * ln(1 - events / n) AS empty FROM ended, facts
)
SELECT 'ok' AS status, n AS n_obs, events, round(coef, 6) AS coef, round({normal_p('z')}, 6) AS pvalue,
  round(exp(coef), 6) AS odds_ratio, round(1 - likelihood / empty, 6) AS pseudo_r2
FROM scored"""

_REVIEW = ("review score by lateness", "reviewed", "review_score", "(NOT is_delayed)")

INFERENCE: dict[str, str] = {
    "review_tests_pvalues": two_groups(*_REVIEW),
    "ticket_tests_pvalues": two_groups("mean ticket by customer group", "customer_summary", "avg_order_value", "has_repurchase"),
    "spearman_pvalue": f"""WITH {_SPEARMAN.strip()}
SELECT 'delay days vs review score' AS label, n, round(rho, 6) AS rho, round({student_p('st', '(n - 2.0::DOUBLE)')}, 6) AS pvalue
FROM spearman""",
    "tests_text": f"""WITH {_groups(*_REVIEW[1:]).strip()}, {_SPEARMAN.strip()}, figures AS (
  SELECT {normal_p('z')} AS mw, rho, {student_p('st', '(n - 2.0::DOUBLE)')} AS sp FROM tested, spearman)
SELECT {_text_p('mw')} AS mannwhitney_pvalue, translate(format('{{:,.2f}}', CAST(rho AS DOUBLE)), ',.', '.,') AS spearman_rho,
  {_text_p('sp')} AS spearman_pvalue
FROM figures""",
    "driver_ols": _OLS,
    "regression_output": _OUTPUT,
    "driver_scenario": _SCENARIO,
    "negative_review_logit": _LOGIT,
}
