"""SQL twins of measures under slicers: seller and product filters, calendar attributes, date roles, forecast cells."""

from __future__ import annotations

_ASIA = "(SELECT i.* FROM bi_items AS i JOIN c_sellers AS s USING (seller_id) WHERE s.raw_state = 'ASIA')"
_CATEGORY = "(SELECT * FROM bi_items WHERE category = 'Brand#11')"
_LATE = "count(DISTINCT order_id) FILTER (WHERE is_late)"

_PODIUM = f"""WITH totals AS (
  SELECT seller_id, sum(price) AS v, count(DISTINCT order_id) AS n, count(*) AS i FROM {_CATEGORY} GROUP BY 1
), placed_sellers AS (
  SELECT *, rank() OVER (ORDER BY score, v DESC) AS place FROM (
    SELECT *, dense_rank() OVER (ORDER BY v DESC) + dense_rank() OVER (ORDER BY n DESC) + dense_rank() OVER (ORDER BY i DESC) AS score
    FROM totals)
)"""

_CELLS = """WITH cell_sales AS (
  SELECT {key} AS cell, purchase_month AS ym, last_day(min(d_purchase)) AS e, sum(price) AS v FROM {source} GROUP BY 1, 2
), cell_base AS (
  SELECT cell, avg(v) AS b FROM cell_sales, valid_month WHERE e <= m AND e > last_day(m - INTERVAL 3 MONTH) GROUP BY 1
), cell_real AS (
  SELECT {key} AS cell, last_day(max(purchase)) AS r FROM {source} GROUP BY 1
), cell_months AS (
  SELECT cell, year_month, month_end, b FROM cell_base, cal_months, valid_month
  WHERE month_end > m AND month_end <= last_day(m + INTERVAL 3 MONTH)
), cell_three AS (
  SELECT cell, sum(b) FILTER (WHERE month_end > r AND month_end <= last_day(r + INTERVAL 3 MONTH)) AS base
  FROM cell_months JOIN cell_real USING (cell) GROUP BY 1
), settings AS (
  SELECT * FROM grid WHERE late_reduction IN (0, 10) AND repurchase_increase = 5 AND seller_expansion IN (0, 20)
), cell_results AS (
  SELECT cell, late_reduction, repurchase_increase, seller_expansion, base, base * (1 + impact) AS projected FROM cell_three, settings
)"""
_BY_STATE = _CELLS.format(key="raw_state", source="bi_items")
# The latest purchase of a state counts orders without items too.
_BY_STATE = _BY_STATE.replace("last_day(max(purchase)) AS r FROM bi_items", "last_day(max(purchase)) AS r FROM bi_orders")
_ONE_CATEGORY = _CELLS.format(key="1", source=_CATEGORY)
_SLIDERS = "late_reduction, repurchase_increase, seller_expansion"


def _returning(source: str, first_source: str, column: str, alias: str) -> str:
    """Customers of ``source`` by month who bought in ``first_source`` in an earlier month."""
    return f"""
FROM (SELECT purchase_month AS ym, {column} AS {alias}, customer_unique_id FROM {source}) AS x
JOIN (SELECT customer_unique_id, strftime(min(purchase), '%Y-%m') AS first FROM {first_source} GROUP BY 1) AS f
  USING (customer_unique_id)"""


def _month_revenue(role: str) -> str:
    return f"SELECT strftime({role}, '%Y-%m') AS year_month, round(sum(price), 2) AS product_revenue FROM bi_items GROUP BY 1"


SLICERS: dict[str, str] = {
    "m01_revenue_growth_card_of_category": f"""WITH sales AS (
  SELECT strftime(delivery, '%Y-%m') AS ym, sum(price) AS v FROM {_CATEGORY} WHERE is_delivered AND delivery IS NOT NULL GROUP BY 1)
SELECT c.year_month, round((coalesce(a.v, 0) - p.v) / p.v, 6) AS revenue_growth
FROM cal_months AS c JOIN sales AS p ON p.ym = strftime(c.month_start - INTERVAL 1 MONTH, '%Y-%m')
LEFT JOIN sales AS a ON a.ym = c.year_month""",
    "m02_average_installments_of_asian_sellers": f"""
SELECT purchase_month AS year_month, round(avg(k), 6) AS average_installments
FROM (SELECT DISTINCT order_id, purchase_month FROM {_ASIA})
JOIN (SELECT order_id, max(installments) AS k FROM c_payments GROUP BY 1) USING (order_id) GROUP BY 1""",
    "m03_orders_by_quarter": """
SELECT CAST(year(d) AS INTEGER) AS year, 'T' || quarter(d) AS quarter, count(DISTINCT order_id) AS orders
FROM bi_orders LEFT JOIN cal ON d = d_purchase GROUP BY 1, 2""",
    "m04_revenue_by_delivery_of_category": f"""
SELECT strftime(delivery, '%Y-%m') AS year_month, round(sum(price), 2) AS revenue_by_delivery FROM {_CATEGORY}
WHERE is_delivered AND delivery IS NOT NULL GROUP BY 1""",
    "m04_revenue_by_delivery_by_year": """
SELECT CAST(year(d) AS INTEGER) AS year, round(sum(price), 2) AS revenue_by_delivery FROM bi_items JOIN cal ON d = d_delivered
WHERE is_delivered AND month(d) <= 6 GROUP BY 1""",
    "m08_late_share_by_weekday": f"""
SELECT CAST(isodow(d) AS INTEGER) AS weekday_number, dayname(d) AS weekday_name,
  round({_LATE} / count(DISTINCT order_id) FILTER (WHERE is_delivered), 6) AS late_share
FROM bi_orders LEFT JOIN cal ON d = d_purchase GROUP BY 1, 2 HAVING {_LATE} > 0""",
    "m20_average_score_in_date_range": """
SELECT 'T' || quarter(d) AS quarter, round(avg(review_score), 6) AS average_score FROM bi_orders JOIN cal ON d = d_purchase
WHERE d >= DATE '1996-02-10' AND d < DATE '1997-11-20' GROUP BY 1 HAVING count(review_score) > 0""",
    "m27_orders_by_seller_alias": f"""
SELECT alias AS seller_alias, count(DISTINCT order_id) AS orders_by_seller FROM {_CATEGORY} JOIN aliases USING (seller_id) GROUP BY 1""",
    "m28_seller_delay_rank_in_asia": """
SELECT seller_id, dense_rank() OVER (ORDER BY s DESC) AS seller_delay_rank FROM (
SELECT seller_id, CAST(count(DISTINCT order_id) * sum(days_late) FILTER (WHERE is_delivered) AS DOUBLE)
  / count(days_late) FILTER (WHERE is_delivered) AS s
FROM seller_orders_bi AS o JOIN (SELECT seller_id FROM c_sellers WHERE raw_state = 'ASIA') USING (seller_id) GROUP BY 1) WHERE s > 0""",
    "m29_returning_share_of_asian_sellers": f"""
SELECT ym AS year_month, round(count(DISTINCT customer_unique_id) FILTER (WHERE first < ym) / count(DISTINCT customer_unique_id), 6)
  AS returning_share
{_returning(_ASIA, _ASIA, "''", "c")} GROUP BY 1 HAVING count(*) FILTER (WHERE first < ym) > 0""",
    "m30_returning_customers_of_asian_sellers": f"""
SELECT ym AS year_month, product_category_name, count(DISTINCT customer_unique_id) AS returning_customers
{_returning(f"(SELECT * FROM {_ASIA} WHERE category < 'Brand#3')", _ASIA, "category", "product_category_name")}
WHERE first < ym GROUP BY 1, 2""",
    "m35_items_of_recurring_customers_of_asian_sellers": f"""
SELECT purchase_month AS year_month, count(*) AS items_of_recurring_customers FROM {_ASIA}
WHERE category < 'Brand#3' AND (purchase_month, customer_unique_id) IN (
  SELECT (purchase_month, customer_unique_id) FROM {_ASIA} GROUP BY purchase_month, customer_unique_id
  HAVING count(DISTINCT order_id) >= 2) GROUP BY 1""",
    "m39_top_1_revenue_of_category": f"""{_PODIUM}
SELECT 'R$ ' || format('{{:,}}', CAST(round(max(v), 0) AS BIGINT)) AS top_1_revenue FROM placed_sellers WHERE place = 1""",
    "m44_top_3_seller_of_category": f"""{_PODIUM}
SELECT max(alias) AS top_3_seller FROM placed_sellers JOIN aliases USING (seller_id) WHERE place = 3""",
    "m45_strategic_revenue_share_of_asian_sellers": f"""WITH ranked AS (
  SELECT ym, v, row_number() OVER (PARTITION BY ym ORDER BY v DESC, seller_id) AS k
  FROM (SELECT purchase_month AS ym, seller_id, round(sum(price), 2) AS v FROM {_ASIA} GROUP BY 1, 2))
SELECT ym AS year_month, round(sum(v) / (SELECT sum(price) FROM bi_items AS b WHERE b.purchase_month = ym), 6) AS strategic_revenue_share
FROM ranked WHERE k <= 10 GROUP BY 1""",
    "m46_projected_gain_share_by_state": f"""{_BY_STATE}
SELECT cell AS customer_state, {_SLIDERS}, round((projected - base) / base, 6) AS projected_gain_share FROM cell_results""",
    "m47_forecast_baseline_by_state": f"""{_BY_STATE}
SELECT year_month, cell AS customer_state, round(b, 2) AS forecast_baseline FROM cell_months""",
    "m48_forecast_simulated_by_state": f"""{_BY_STATE}
SELECT year_month, cell AS customer_state, {_SLIDERS}, round(b * (1 + impact), 0) AS forecast_simulated FROM cell_months, settings""",
    "m49_shown_history_by_category": """
SELECT purchase_month AS year_month, category AS product_category_name, round(sum(price), 2) AS shown_revenue
FROM bi_items, valid_month WHERE last_day(d_purchase) <= m GROUP BY 1, 2""",
    "m50_projected_3_months_by_state": f"""{_BY_STATE}
SELECT cell AS customer_state, {_SLIDERS}, round(projected, 0) AS projected_3_months FROM cell_results""",
    "m51_simulation_text_by_state": f"""{_BY_STATE}
SELECT cell AS customer_state, {_SLIDERS},
 'Com redução de atraso de ' || late_reduction || '%, aumento de recompra de ' || repurchase_increase ||
 '% e expansão de sellers estratégicos de ' || seller_expansion || '%, a receita projetada para os próximos 3 meses é de ' ||
 coalesce('R$ ' || format('{{:,}}', CAST(round(projected, 0) AS BIGINT)), '') || ', representando uma variação de ' ||
 coalesce(format('{{:.1f}}%', round((projected - base) / base * 100, 1)), '') || ' sobre o baseline.' AS simulation_text
FROM cell_results""",
    "m52_projected_gain_of_category": f"""{_ONE_CATEGORY}
SELECT {_SLIDERS}, round(projected - base, 0) AS projected_gain FROM settings LEFT JOIN cell_results USING ({_SLIDERS})""",
    "m56_baseline_3_months_by_state": f"{_BY_STATE}\nSELECT cell AS customer_state, round(base, 2) AS baseline_3_months FROM cell_three",
    "m57_base_revenue_3m_by_state": f"{_BY_STATE}\nSELECT cell AS customer_state, round(b, 2) AS base_revenue_3m FROM cell_base",
    "m59_product_revenue_by_approved_month": _month_revenue("approved"),
    "m59_product_revenue_by_carrier_month": _month_revenue("carrier"),
    "m59_product_revenue_by_estimated_month": _month_revenue("estimated"),
    "m63_last_real_date_by_state": "SELECT raw_state AS customer_state, max(purchase) AS last_real_date FROM bi_orders GROUP BY 1",
    "m64_last_real_month_by_category": """
SELECT category AS product_category_name, last_day(max(purchase)) AS last_real_month FROM bi_items GROUP BY 1""",
}
