"""DuckDB SQL twin of each registered query. Columns carry the same names."""

from __future__ import annotations

from oracles.inference import INFERENCE
from oracles.prefix import with_ctes
from oracles.slicers import SLICERS


def _concentration(source: str, label: str, value: str = "item_revenue") -> str:
    return f"""
SELECT label AS {label}, round(v, {2 if value == 'item_revenue' else 6}) AS {value}, round(v / total, 6) AS share,
       round(sum(v) OVER w / total, 6) AS cum_share, row_number() OVER w AS rank
FROM (SELECT label, sum(v) AS v, sum(sum(v)) OVER () AS total FROM ({source}) GROUP BY label)
WINDOW w AS (ORDER BY {'round(v, 2)' if value == 'item_revenue' else 'round(v, 9)'} DESC, label
             ROWS UNBOUNDED PRECEDING)"""


_CITY = _concentration("SELECT customer_city AS label, price AS v FROM item_level", "customer_city")
_SELLER = _concentration("SELECT CAST(seller_id AS VARCHAR) AS label, price AS v FROM item_level", "seller_id")
_CATEGORY = _concentration("SELECT product_category_final AS label, price AS v FROM item_level", "product_category_final")
_STATE = _concentration("SELECT customer_state AS label, price AS v FROM item_level", "customer_state")
_REPURCHASE = _concentration(
    "SELECT product_category_final AS label, price AS v FROM item_level WHERE customer_unique_id IN "
    "(SELECT customer_unique_id FROM customer_summary WHERE has_repurchase)",
    "product_category_final",
)
_RISK_PARETO = _concentration(
    "SELECT CAST(seller_id AS VARCHAR) AS label, risk_score AS v FROM risk_scored WHERE seller_orders >= 20 OR "
    "NOT EXISTS (SELECT 1 FROM risk_scored WHERE seller_orders >= 20)",
    "seller_id",
    "risk_score",
)


def _risk(min_orders: int) -> str:
    return f"""
SELECT seller_id, seller_orders, round(seller_revenue, 2) AS seller_revenue, delayed_orders,
       round(avg_delay_days, 6) AS avg_delay_days, round(avg_lead_time_days, 6) AS avg_lead_time_days,
       round(avg_review_score, 6) AS avg_review_score, round(avg_late_review_score, 6) AS avg_late_review_score,
       round(avg_on_time_review_score, 6) AS avg_on_time_review_score, round(late_rate, 6) AS late_rate,
       round(impact_on_review, 6) AS impact_on_review, round(risk_score, 6) AS risk_score,
       seller_orders >= {min_orders} AS eligible_risk_ranking,
       row_number() OVER (ORDER BY seller_orders >= {min_orders} DESC, round(risk_score, 9) DESC, seller_id) AS risk_rank
FROM risk_scored"""


def _control(value: str, low: str, digits: int) -> str:
    del digits
    return f"""
SELECT round(cl, 2) AS center_line, round(cl + 3 * sd, 2) AS upper_control_limit,
       round({low}, 2) AS lower_control_limit,
       coalesce((SELECT string_agg(year_month, ', ' ORDER BY year_month) FROM monthly
                 WHERE {value} > cl + 3 * sd OR {value} < {low}), '') AS out_of_control_periods
FROM (SELECT avg({value}) AS cl, stddev_samp({value}) AS sd FROM monthly HAVING count({value}) >= 3)"""


_PCHART_POINTS = """
SELECT year_month AS period, late_rate AS rate, p, least(1, greatest(0, p + 3 * sqrt(p * (1 - p) / n))) AS u,
       least(1, greatest(0, p - 3 * sqrt(p * (1 - p) / n))) AS l
FROM (SELECT year_month, late_rate, delivered_orders_valid AS n,
             sum(delayed_orders) OVER () / sum(delivered_orders_valid) OVER () AS p
      FROM monthly WHERE delivered_orders_valid > 0)"""


def _trend(value: str, digits: int) -> str:
    return f"""
SELECT year_month AS period, round({value}, 2) AS value, round(a, 2) AS slope, round(b, 2) AS intercept,
       round(b + a * x, 2) AS trend
FROM (SELECT *, regr_slope({value}, x) OVER () AS a, regr_intercept({value}, x) OVER () AS b
      FROM (SELECT year_month, {value}, CAST(row_number() OVER (ORDER BY month) - 1 AS DOUBLE) AS x FROM monthly))"""


def _welch(source: str, value: str, flag: str) -> str:
    return f"""
SELECT na AS n_group_a, nb AS n_group_b, round(ma, {{d}}) AS mean_group_a, round(mb, {{d}}) AS mean_group_b,
       round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t_statistic,
       round((va / na + vb / nb) * (va / na + vb / nb) /
             ((va / na) * (va / na) / (na - 1) + (vb / nb) * (vb / nb) / (nb - 1)), 6) AS degrees_of_freedom,
       least(na, nb) < 20 AS small_sample
FROM (SELECT count(*) FILTER (WHERE {flag}) AS na, count(*) FILTER (WHERE NOT {flag}) AS nb,
             avg({value}) FILTER (WHERE {flag}) AS ma, avg({value}) FILTER (WHERE NOT {flag}) AS mb,
             var_samp({value}) FILTER (WHERE {flag}) AS va, var_samp({value}) FILTER (WHERE NOT {flag}) AS vb
      FROM {source})""".replace("{d}", "6")


def _mann_whitney(source: str, value: str, flag: str) -> str:
    return f"""
SELECT na AS n_group_a, nb AS n_group_b, round(u, 6) AS u_statistic, round(na * nb / 2.0::DOUBLE, 6) AS u_mean,
       round(sd, 6) AS u_deviation,
       round((greatest(u, na * nb - u) - na * nb / 2.0::DOUBLE - 0.5::DOUBLE) / sd, 6) AS z_statistic,
       least(na, nb) <= 8 AND most = 1 AS exact_advised
FROM (SELECT na, nb, ra - na * (na + 1) / 2.0::DOUBLE AS u, most,
             sqrt(na * nb / 12.0::DOUBLE * ((na + nb + 1) - ties / ((na + nb) * (na + nb - 1)))) AS sd
      FROM (SELECT count(*) FILTER (WHERE f) AS na, count(*) FILTER (WHERE NOT f) AS nb,
                   sum(CAST(rk AS DOUBLE)) FILTER (WHERE f) AS ra, max(t) AS most,
                   sum((CAST(t AS DOUBLE) * t * t - t) / t) AS ties
            FROM (SELECT {flag} AS f, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk,
                         count(*) OVER (PARTITION BY v) AS t
                  FROM (SELECT {flag}, round({value}, 9) AS v FROM {source}))))"""


def _br(expr: str, decimals: int) -> str:
    """Brazilian number text of a SQL double."""
    return f"translate(format('{{:,.{decimals}f}}', CAST({expr} AS DOUBLE)), ',.', '.,')"


_PERIOD = "year_month"


def _by_month(select: str, having: str = "", source: str = "bi_orders") -> str:
    return f"SELECT purchase_month AS year_month, {select} FROM {source} GROUP BY 1 {having}"


_STARS = (
    "repeat('★', CAST(least(5, greatest(0, floor(coalesce({0}, 0)))) AS INTEGER)) || "
    "repeat('☆', CAST(5 - least(5, greatest(0, floor(coalesce({0}, 0)))) AS INTEGER))"
)
_LATE_SCORE = "avg(review_score) FILTER (WHERE is_late)"
_TIME_SCORE = "avg(review_score) FILTER (WHERE is_on_time)"
_DELIVERED = "count(DISTINCT order_id) FILTER (WHERE is_delivered)"
_LATE = "count(DISTINCT order_id) FILTER (WHERE is_late)"
_ON_TIME = "count(DISTINCT order_id) FILTER (WHERE is_on_time)"


def _returning(category: bool) -> str:
    column = ", category AS product_category_name" if category else ""
    group = ", 2" if category else ""
    return f"""
SELECT purchase_month AS year_month{column}, count(DISTINCT i.customer_unique_id) AS returning_customers
FROM bi_items i JOIN first_orders f USING (customer_unique_id)
WHERE strftime(f.first_purchase, '%Y-%m') < i.purchase_month GROUP BY 1{group}"""


def _recurring(by_category: bool) -> str:
    column, group = (", category AS product_category_name", ", 2") if by_category else ("", "")
    return f"""
SELECT i.purchase_month AS year_month{column}, count(*) AS items_of_recurring_customers FROM bi_items i
WHERE (i.purchase_month, i.customer_unique_id) IN
      (SELECT (purchase_month, customer_unique_id) FROM bi_items GROUP BY purchase_month, customer_unique_id
       HAVING count(DISTINCT order_id) >= 2) GROUP BY 1{group}"""


def _podium_revenue(place: int) -> str:
    return f"SELECT 'R$ ' || format('{{:,}}', CAST(round(max(v), 0) AS BIGINT)) AS top_{place}_revenue FROM podium WHERE place = {place}"


def _podium_alias(place: int) -> str:
    return f"SELECT max(alias) AS top_{place}_seller FROM podium JOIN aliases USING (seller_id) WHERE place = {place}"


_CALENDAR = """
SELECT d AS date, strftime(d, '%Y-%m-%d') AS date_id, CAST(year(d) AS INTEGER) AS year,
       CAST(month(d) AS INTEGER) AS month_number, {names}
       strftime(d, '%Y-%m') AS year_month, CAST(year(d) * 100 + month(d) AS INTEGER) AS year_month_order,
       'T' || CAST(quarter(d) AS VARCHAR) AS quarter, CAST(isodow(d) AS INTEGER) AS weekday_number,
       CAST((dayofyear(d) - 1 + isodow(CAST(date_trunc('year', d) AS DATE)) - 1) // 7 + 1 AS INTEGER) AS week_of_year
FROM cal"""
_NAMES_EN = """monthname(d) AS month_name, left(monthname(d), 3) AS month_short, dayname(d) AS weekday_name,"""
_NAMES_PT = """
  (['janeiro','fevereiro','março','abril','maio','junho','julho','agosto','setembro','outubro','novembro','dezembro'])[month(d)] AS month_name,
  left((['janeiro','fevereiro','março','abril','maio','junho','julho','agosto','setembro','outubro','novembro','dezembro'])[month(d)], 3) AS month_short,
  (['segunda-feira','terça-feira','quarta-feira','quinta-feira','sexta-feira','sábado','domingo'])[isodow(d)] AS weekday_name,"""

_KPIS = f"""
SELECT (SELECT sum(share) * 100 FROM shares_city WHERE k <= 1) AS city1,
       (SELECT sum(share) * 100 FROM shares_city WHERE k <= 10) AS city10,
       (SELECT sum(share) * 100 FROM shares_category WHERE k <= 5) AS category5,
       (SELECT sum(share) * 100 FROM shares_category WHERE k <= 10) AS category10,
       (SELECT sum(share) * 100 FROM shares_seller WHERE k <= 10) AS seller10,
       g.*, c.*, (SELECT sum(total_revenue) FILTER (WHERE strategic) / sum(total_revenue) FROM strategic_flag) AS global_share,
       (SELECT max_by(strategic_revenue_share, month) FROM strategic_series) AS latest_share
FROM review_gap g, (SELECT count(*) AS customers, avg(customer_orders) AS frequency,
       avg(CASE WHEN has_repurchase THEN 1.0 ELSE 0.0 END) * 100 AS repurchase,
       sum(customer_revenue) FILTER (WHERE has_repurchase) AS repurchase_revenue FROM customer_summary) c"""


def _shares(label: str, column: str) -> str:
    return f"""shares_{label} AS (SELECT v / sum(v) OVER () AS share, row_number() OVER (ORDER BY v DESC) AS k
FROM (SELECT {column}, sum(price) AS v FROM item_level GROUP BY 1))"""


def _kpi_query(select: str) -> str:
    body = with_ctes(_KPIS + " -- item_level")
    shares = ",\n".join(
        [_shares("city", "customer_city"), _shares("category", "product_category_final"), _shares("seller", "seller_id")]
    )
    head, tail = body.rsplit("\nSELECT (SELECT sum(share)", 1)
    tail = tail.replace(" -- item_level", "")
    return f"{head},\n{shares},\nkpi AS (SELECT (SELECT sum(share){tail})\n{select}"


_KPI_SELECT = """
SELECT round(city1, 6) AS city_top1_share_pct, round(city10, 6) AS city_top10_share_pct,
       round(category5, 6) AS category_top5_share_pct, round(category10, 6) AS category_top10_share_pct,
       round(seller10, 6) AS seller_top10_share_pct, round(general, 6) AS general_mean_review,
       round(on_time, 6) AS on_time_mean_review, round(late, 6) AS delayed_mean_review,
       round(on_time - late, 6) AS review_gap_points, round((late - on_time) / on_time * 100, 6) AS review_gap_pct,
       customers AS total_customers, round(frequency, 6) AS avg_orders_per_customer,
       round(repurchase, 6) AS pct_customers_with_repurchase,
       round(repurchase_revenue, 2) AS revenue_repurchase_customers,
       round(global_share, 6) AS strategic_global_share, round(latest_share, 6) AS strategic_latest_share FROM kpi"""

_KPI_TEXT = f"""
SELECT unnest(['city_top10_share','city_top1_share','category_top5_share','category_top10_share','seller_top10_share',
 'on_time_mean_review','delayed_mean_review','review_gap_points','review_gap_pct','total_customers','avg_orders_per_customer',
 'pct_customers_with_repurchase','revenue_repurchase_customers','revenue_axis_label','strategic_global_share']) AS figure,
 unnest([{_br('city10', 2)} || '%', {_br('city1', 2)} || '%', {_br('category5', 2)} || '%', {_br('category10', 2)} || '%',
 {_br('seller10', 2)} || '%', {_br('on_time', 2)}, {_br('late', 2)}, {_br('on_time - late', 2)},
 {_br('(late - on_time) / on_time * 100', 2)} || '%', {_br('customers', 0)}, {_br('frequency', 2)}, {_br('repurchase', 2)} || '%',
 'R$ ' || {_br('repurchase_revenue', 2)},
 CASE WHEN abs(repurchase_revenue) >= 1e6 THEN 'R$ ' || format('{{:.1f}}M', repurchase_revenue / 1e6)
      WHEN abs(repurchase_revenue) >= 1e3 THEN 'R$ ' || format('{{:.0f}}k', repurchase_revenue / 1e3)
      ELSE 'R$ ' || format('{{:.0f}}', repurchase_revenue) END,
 {_br('global_share * 100', 2)} || '%']) AS text FROM kpi"""

_RAW: dict[str, str] = {
    "order_level": """
SELECT order_id, customer_id, order_status, purchase AS order_purchase_timestamp, approved AS order_approved_at,
       carrier AS order_delivered_carrier_date, delivery AS order_delivered_customer_date,
       estimated AS order_estimated_delivery_date, reference_date, month, year_month,
       valid AS delivered_with_valid_dates, is_delayed, round(delay_days, 6) AS delay_days,
       round(lead_time_days, 6) AS lead_time_days, round(order_revenue, 2) AS order_revenue, item_count, seller_count,
       product_count, customer_unique_id, customer_city, customer_state, round(review_score, 6) AS review_score,
       review_count, seq AS customer_order_sequence, customer_total AS customer_total_orders,
       seq > 1 AS is_repurchase_order, customer_total > 1 AS customer_has_repurchase,
       (SELECT t FROM threshold) AS negative_review_threshold,
       CAST(review_score <= (SELECT t FROM threshold) AS DOUBLE) AS negative_review_flag FROM order_level""",
    "item_fact": """
SELECT order_id, order_item_id, product_id, seller_id, customer_unique_id, customer_city, customer_state,
       product_category_final, seller_city, seller_state, reference_date, year_month, round(price, 2) AS item_revenue,
       round(freight_value, 4) AS freight_value, round(price + freight_value, 4) AS item_revenue_with_freight
FROM item_level""",
    "seller_order": """
SELECT order_id, seller_id, round(revenue, 2) AS seller_order_revenue, items AS seller_item_count,
       products AS seller_product_count, seller_city, seller_state, purchase AS order_purchase_timestamp, month,
       year_month, valid AS delivered_with_valid_dates, is_delayed, round(delay_days, 6) AS delay_days,
       round(lead_time_days, 6) AS lead_time_days, round(review_score, 6) AS review_score, review_count,
       CAST(review_score <= (SELECT t FROM threshold) AS DOUBLE) AS negative_review_flag FROM seller_order""",
    "negative_review_threshold": "SELECT negative_reviews, t AS negative_review_threshold FROM threshold",
    "negative_review_flag": """
SELECT order_id, round(review_score, 6) AS review_score,
       CAST(review_score <= (SELECT t FROM threshold) AS DOUBLE) AS negative_review_flag
FROM order_level WHERE review_score IS NOT NULL""",
    "excluded_count": """
SELECT count(*) AS delivered_orders,
       count(*) FILTER (WHERE delivery >= TIMESTAMP '1995-01-01' AND delivery < TIMESTAMP '2001-12-01') AS kept_orders,
       count(*) FILTER (WHERE NOT (delivery >= TIMESTAMP '1995-01-01' AND delivery < TIMESTAMP '2001-12-01'))
         AS excluded_orders FROM delivered_all""",
    "complete_month_bounds": "SELECT s AS start, e AS end, dropped FROM bounds",
    "daily_revenue": "SELECT purchase_date, round(daily_revenue, 2) AS daily_revenue, daily_orders FROM daily",
    "monthly_ohlc": """
SELECT CAST(date_trunc('month', purchase_date) AS DATE) AS month, strftime(purchase_date, '%Y-%m') AS label,
       round(first(daily_revenue ORDER BY purchase_date), 2) AS open, round(max(daily_revenue), 2) AS high,
       round(min(daily_revenue), 2) AS low, round(last(daily_revenue ORDER BY purchase_date), 2) AS close,
       CAST(sum(daily_orders) AS BIGINT) AS volume
FROM daily, bounds b WHERE date_trunc('month', purchase_date) BETWEEN b.s AND b.e GROUP BY 1, 2""",
}

_MONTHLY_COLUMNS = """month, year_month, round(revenue_month, 2) AS revenue_month, orders_month,
       round(avg_ticket_month + 1e-6, 4) AS avg_ticket_month, unique_customers, delivered_orders_valid, delayed_orders,
       round(avg_delay_days, 6) AS avg_delay_days, round(avg_lead_time_days, 6) AS avg_lead_time_days,
       round(avg_review_score, 6) AS avg_review_score, round(negative_review_rate, 6) AS negative_review_rate,
       review_count, new_customers, repurchase_customers, round(repurchase_order_rate, 6) AS repurchase_order_rate,
       round(late_rate, 6) AS late_rate, round(repurchase_customer_rate, 6) AS repurchase_customer_rate,
       round(revenue_mom_pct, 6) AS revenue_mom_pct, round(orders_mom_pct, 6) AS orders_mom_pct,
       round(ticket_mom_pct, 6) AS ticket_mom_pct"""

_RAW |= {
    "monthly_metrics": f"SELECT {_MONTHLY_COLUMNS} FROM monthly",
    "monthly_enriched": f"""
SELECT {_MONTHLY_COLUMNS}, round(strategic_revenue_share, 6) AS strategic_revenue_share,
       round(strategic_orders_share, 6) AS strategic_orders_share, round(strategic_revenue, 2) AS strategic_revenue,
       strategic_orders FROM enriched""",
    "monthly_business_output": """
SELECT year_month AS ano_mes, round(revenue_month, 2) AS receita_mensal, orders_month AS pedidos_mensais,
       round(avg_ticket_month + 1e-6, 4) AS ticket_medio_mensal, round(revenue_mom_pct, 6) AS variacao_receita_mom_pct,
       round(orders_mom_pct, 6) AS variacao_pedidos_mom_pct, round(ticket_mom_pct, 6) AS variacao_ticket_mom_pct,
       delivered_orders_valid AS pedidos_entregues_validos, delayed_orders AS pedidos_atrasados,
       round(late_rate * 100, 6) AS taxa_atraso_pct, round(avg_delay_days, 6) AS atraso_medio_dias,
       round(avg_lead_time_days, 6) AS lead_time_medio_dias, round(avg_review_score, 6) AS nota_media_mensal,
       round(negative_review_rate * 100, 6) AS taxa_reviews_negativas_pct, unique_customers AS clientes_unicos,
       new_customers AS novos_clientes, repurchase_customers AS clientes_com_recompra,
       round(repurchase_customer_rate * 100, 6) AS taxa_clientes_com_recompra_pct,
       round(strategic_revenue_share * 100, 6) AS percentual_receita_sellers_estrategicos,
       round(strategic_orders_share * 100, 6) AS percentual_pedidos_sellers_estrategicos FROM enriched""",
    "concentration_city": _CITY,
    "concentration_seller": _SELLER,
    "concentration_category": _CATEGORY,
    "concentration_state": _STATE,
    "pareto_top15_city": f"SELECT * FROM ({_CITY}) WHERE rank <= 15",
    "pareto_top15_seller": f"SELECT * FROM ({_SELLER}) WHERE rank <= 15",
    "control_revenue": _control("revenue_month", "greatest(0, cl - 3 * sd)", 2),
    "control_orders": _control("orders_month", "greatest(0, cl - 3 * sd)", 2),
    "control_review": _control("avg_review_score", "cl - 3 * sd", 2),
    "pchart_late_points": f"""
SELECT period, round(rate, 6) AS rate, round(p, 2) AS center_line, round(u, 2) AS upper_control_limit,
       round(l, 2) AS lower_control_limit, rate > u OR rate < l AS out_of_control FROM ({_PCHART_POINTS})""",
    "pchart_late": f"""
SELECT round(max(p), 2) AS center_line, round(max(u), 2) AS upper_control_limit, round(min(l), 2) AS lower_control_limit,
       coalesce(string_agg(period, ', ' ORDER BY period) FILTER (WHERE rate > u OR rate < l), '') AS out_of_control_periods
FROM ({_PCHART_POINTS})""",
    "trend_revenue": _trend("revenue_month", 2),
    "trend_late_rate": _trend("late_rate", 2),
    "delay_vs_review": """
SELECT round(general, 6) AS general_mean_review, round(on_time, 6) AS on_time_mean_review,
       round(late, 6) AS delayed_mean_review, round(delay, 6) AS avg_delay_days, n AS reviewed_orders,
       round(on_time - late, 6) AS review_gap_points, round((late - on_time) / on_time * 100, 6) AS review_gap_pct
FROM review_gap""",
    "seller_delay_review": """
SELECT seller_id, count(DISTINCT order_id) AS seller_orders, round(avg(delay_days), 6) AS avg_delay_days,
       round(avg(review_score), 6) AS avg_review_score FROM seller_order
WHERE valid AND review_score IS NOT NULL GROUP BY 1 HAVING count(DISTINCT order_id) >= 20""",
    "bubble_sizes": """
SELECT *, round((seller_orders - min(seller_orders) OVER () + 1) /
                (max(seller_orders) OVER () - min(seller_orders) OVER () + 1) * 800, 6) AS bubble_size
FROM (SELECT seller_id, count(DISTINCT order_id) AS seller_orders, round(avg(delay_days), 6) AS avg_delay_days,
             round(avg(review_score), 6) AS avg_review_score FROM seller_order
      WHERE valid AND review_score IS NOT NULL GROUP BY 1 HAVING count(DISTINCT order_id) >= 20)""",
    "box_review_by_delay": """
WITH q AS (SELECT is_delayed, count(*) AS n, quantile_cont(review_score, 0.25) AS q1,
                  quantile_cont(review_score, 0.5) AS q2, quantile_cont(review_score, 0.75) AS q3
           FROM reviewed GROUP BY 1),
marked AS (SELECT r.is_delayed, n, q1, q2, q3, review_score AS x, review_score < q1 - 1.5 * (q3 - q1) AS below,
                  review_score > q3 + 1.5 * (q3 - q1) AS above FROM reviewed r JOIN q USING (is_delayed))
SELECT is_delayed, n AS rows, q1, q2 AS median, q3, least(q1, min(x) FILTER (WHERE NOT below AND NOT above)) AS whisker_low,
       greatest(q3, max(x) FILTER (WHERE NOT below AND NOT above)) AS whisker_high,
       count(*) FILTER (WHERE below OR above) AS outliers, min(x) FILTER (WHERE below OR above) AS lowest_outlier,
       max(x) FILTER (WHERE below OR above) AS highest_outlier
FROM marked GROUP BY is_delayed, n, q1, q2, q3""",
    "seller_risk": _risk(20),
    "seller_risk_high_volume": _risk(200),
    "risk_pareto": _RISK_PARETO,
    "risk_bubbles": """
SELECT seller_id, round(late_rate, 6) AS late_rate, seller_orders, round(impact_on_review, 6) AS impact_on_review,
       round((impact_on_review - min(impact_on_review) OVER () + 1) /
             (max(impact_on_review) OVER () - min(impact_on_review) OVER () + 1) * 800, 6) AS bubble_size
FROM risk_scored WHERE seller_orders >= 20 OR NOT EXISTS (SELECT 1 FROM risk_scored WHERE seller_orders >= 20)""",
    "top_detractors": """
SELECT seller_id, seller_orders, round(late_rate, 6) AS late_rate, round(avg_delay_days, 6) AS avg_delay_days,
       round(avg_review_score, 6) AS avg_review_score, round(risk_score, 6) AS risk_score
FROM risk_scored WHERE seller_orders >= 20 OR NOT EXISTS (SELECT 1 FROM risk_scored WHERE seller_orders >= 20)
ORDER BY round(risk_scored.risk_score, 9) DESC, seller_id LIMIT 10""",
    "top_detractors_text": f"""
SELECT seller_id, seller_orders, {_br('late_rate * 100', 2)} || '%' AS late_rate, {_br('avg_delay_days', 2)} AS avg_delay_days,
       {_br('avg_review_score', 2)} AS avg_review_score, {_br('risk_score', 2)} AS risk_score
FROM (SELECT * FROM risk_scored WHERE seller_orders >= 20 OR NOT EXISTS (SELECT 1 FROM risk_scored WHERE seller_orders >= 20)
      ORDER BY round(risk_score, 9) DESC, seller_id LIMIT 10)""",
    "customer_summary": """
SELECT customer_unique_id, customer_orders, round(customer_revenue, 2) AS customer_revenue,
       round(avg_order_value + 1e-6, 4) AS avg_order_value, first_purchase, has_repurchase FROM customer_summary""",
    "repurchase_kpis": """
SELECT count(*) AS total_customers, round(avg(customer_orders), 6) AS avg_orders_per_customer,
       round(avg(CASE WHEN has_repurchase THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_customers_with_repurchase,
       round(coalesce(sum(customer_revenue) FILTER (WHERE has_repurchase), 0), 2) AS revenue_repurchase_customers,
       round(avg(avg_order_value) FILTER (WHERE has_repurchase) + 1e-6, 4) AS avg_ticket_repurchase_customers,
       round(avg(avg_order_value) FILTER (WHERE NOT has_repurchase) + 1e-6, 4) AS avg_ticket_non_repurchase_customers
FROM customer_summary""",
    "monthly_repurchase": """
SELECT t.month, t.year_month, t.unique_customers, coalesce(n.new_customers, 0) AS new_customers,
       coalesce(r.repurchase_customers, 0) AS repurchase_customers,
       round(coalesce(r.repurchase_customers, 0) / nullif(t.unique_customers, 0), 6) AS repurchase_customer_rate,
       round(p.once + 1e-6, 4) AS avg_ticket_non_repurchase_customers, round(p.again + 1e-6, 4) AS avg_ticket_repurchase_customers
FROM (SELECT month, year_month, count(DISTINCT customer_unique_id) AS unique_customers FROM order_level GROUP BY 1, 2) t
LEFT JOIN (SELECT CAST(date_trunc('month', first_purchase) AS DATE) AS month, count(*) AS new_customers
           FROM customer_summary GROUP BY 1) n USING (month)
LEFT JOIN (SELECT month, count(DISTINCT customer_unique_id) AS repurchase_customers FROM order_level WHERE seq > 1
           GROUP BY 1) r USING (month)
LEFT JOIN (SELECT month, avg(order_revenue) FILTER (WHERE customer_total <= 1) AS once,
                  avg(order_revenue) FILTER (WHERE customer_total > 1) AS again FROM order_level GROUP BY 1) p USING (month),
bounds b WHERE t.month BETWEEN b.s AND b.e""",
    "repurchase_categories": _REPURCHASE,
    "repurchase_categories_text": f"""
SELECT product_category_final, 'R$ ' || {_br('item_revenue', 2)} AS item_revenue, {_br('share * 100', 2)} || '%' AS share, rank
FROM (SELECT label AS product_category_final, v AS item_revenue, v / sum(v) OVER () AS share,
             row_number() OVER (ORDER BY v DESC, label) AS rank
      FROM (SELECT product_category_final AS label, sum(price) AS v FROM item_level WHERE customer_unique_id IN
            (SELECT customer_unique_id FROM customer_summary WHERE has_repurchase) GROUP BY 1)) WHERE rank <= 10""",
    "ticket_by_repurchase": """
SELECT has_repurchase, count(*) AS customers, round(avg(avg_order_value) + 1e-6, 4) AS avg_ticket FROM customer_summary GROUP BY 1""",
    "strategic_sellers": """
SELECT seller_id, round(total_revenue, 2) AS total_revenue, total_orders, total_items,
       round(r, 6) AS total_revenue_pct_rank, round(o, 6) AS total_orders_pct_rank, round(i, 6) AS total_items_pct_rank,
       round(rw, 6) AS total_revenue_weight, round(ow, 6) AS total_orders_weight, round(iw, 6) AS total_items_weight,
       round(score, 6) AS strategic_score, strategic AS strategic_seller FROM strategic_flag""",
    "strategic_monthly": """
SELECT month, year_month, round(total_revenue, 2) AS total_revenue, total_orders, total_items,
       round(strategic_revenue, 2) AS strategic_revenue, strategic_orders, strategic_items,
       round(strategic_revenue_share, 6) AS strategic_revenue_share,
       round(strategic_orders_share, 6) AS strategic_orders_share FROM strategic_series""",
    "strategic_shares": """
SELECT round((SELECT sum(total_revenue) FILTER (WHERE strategic) / sum(total_revenue) FROM strategic_flag), 6)
         AS strategic_global_share,
       round((SELECT max_by(strategic_revenue_share, month) FROM strategic_series), 6) AS strategic_latest_share""",
    "load_summary": """
SELECT 'customers' AS table_name, count(*) AS rows FROM c_customers UNION ALL
SELECT 'orders', count(*) FROM c_orders UNION ALL SELECT 'order_items', count(*) FROM c_items UNION ALL
SELECT 'order_payments', count(*) FROM c_payments UNION ALL SELECT 'order_reviews', count(*) FROM c_reviews UNION ALL
SELECT 'products', count(*) FROM part UNION ALL SELECT 'sellers', count(*) FROM c_sellers UNION ALL
SELECT 'translation', count(*) FROM translated WHERE final <> category""",
    "welch_review": _welch("reviewed", "review_score", "(NOT is_delayed)"),
    "welch_ticket": _welch("customer_summary", "avg_order_value", "has_repurchase"),
    "mannwhitney_review": _mann_whitney("(SELECT review_score, NOT is_delayed AS g FROM reviewed)", "review_score", "g"),
    "mannwhitney_ticket": _mann_whitney("customer_summary", "avg_order_value", "has_repurchase"),
    "spearman_delay_review": """
SELECT n, round(rho, 6) AS rho, round(rho * sqrt((n - 2) / (1 - rho * rho)), 6) AS t_statistic
FROM (SELECT count(*) AS n, corr(rx, ry) AS rho FROM (
  SELECT rank() OVER (ORDER BY delay_days) + (count(*) OVER (PARTITION BY delay_days) - 1) / 2.0::DOUBLE AS rx,
         rank() OVER (ORDER BY review_score) + (count(*) OVER (PARTITION BY review_score) - 1) / 2.0::DOUBLE AS ry
  FROM reviewed))""",
    "driver_dataset": """
SELECT month, year_month, round(revenue_month, 2) AS revenue_month, round(late_rate_pct, 6) AS late_rate_pct,
       round(repurchase_customer_rate_pct, 6) AS repurchase_customer_rate_pct,
       round(strategic_revenue_share_pct, 6) AS strategic_revenue_share_pct,
       round(next_month_revenue, 2) AS next_month_revenue, next_month_label,
       round(growth, 6) AS revenue_growth_m1_pct,
       CASE WHEN growth IS NOT NULL THEN round(least(greatest(growth, (SELECT quantile_cont(growth, 0.05) FROM drivers)),
             (SELECT quantile_cont(growth, 0.95) FROM drivers)), 6) END AS revenue_growth_m1_pct_winsorized FROM drivers""",
    "driver_correlation": "\nUNION ALL\n".join(
        f"SELECT '{a}' AS row, '{b}' AS column, round(corr({a.replace('revenue_growth_m1_pct', 'growth')}, "
        f"{b.replace('revenue_growth_m1_pct', 'growth')}), 6) AS correlation FROM drivers WHERE growth IS NOT NULL"
        for a in ("late_rate_pct", "repurchase_customer_rate_pct", "strategic_revenue_share_pct", "revenue_growth_m1_pct")
        for b in ("late_rate_pct", "repurchase_customer_rate_pct", "strategic_revenue_share_pct", "revenue_growth_m1_pct")
    ),
    "driver_trend": """
SELECT round(regr_slope(growth, strategic_revenue_share_pct), 2) AS slope,
       round(regr_intercept(growth, strategic_revenue_share_pct), 2) AS intercept,
       round(regr_r2(growth, strategic_revenue_share_pct), 6) AS r_squared,
       CAST(regr_count(growth, strategic_revenue_share_pct) AS BIGINT) AS n_obs FROM drivers""",
    "calendar": _CALENDAR.replace("{names}", _NAMES_EN),
    "calendar_pt": _CALENDAR.replace("{names}", _NAMES_PT),
    "order_date_keys": """
SELECT order_id, CAST(purchase AS DATE) AS purchase_day, CAST(purchase AS DATE) AS date_purchase,
       CAST(approved AS DATE) AS date_approved, CAST(carrier AS DATE) AS date_carrier,
       CAST(delivery AS DATE) AS date_delivered, CAST(estimated AS DATE) AS date_estimated,
       raw_city || ', ' || raw_state AS map_location FROM c_orders LEFT JOIN c_customers USING (customer_id)""",
    "seller_alias": "SELECT seller_id, alias AS seller_alias FROM aliases",
    # -------------------------------------------------------------- measures
    "m01_revenue_growth_card": """
SELECT year_month, round((coalesce(cur, 0) - prev) / prev, 6) AS revenue_growth FROM cards WHERE prev IS NOT NULL""",
    "m01_revenue_growth_card_by_state": """
SELECT c.year_month, s.state AS customer_state, round((coalesce(sum(a.v), 0) - p.v) / p.v, 6) AS revenue_growth
FROM cal_months c CROSS JOIN (SELECT DISTINCT raw_state AS state FROM c_customers) s
JOIN delivery_months p ON p.ym = strftime(c.month_start - INTERVAL 1 MONTH, '%Y-%m') AND p.state = s.state
LEFT JOIN delivery_months a ON a.ym = c.year_month AND a.state = s.state GROUP BY c.year_month, s.state, p.v""",
    "m02_average_installments": """
SELECT purchase_month AS year_month, round(avg(k), 6) AS average_installments
FROM (SELECT order_id, max(installments) AS k FROM c_payments GROUP BY 1) JOIN c_orders USING (order_id) GROUP BY 1""",
    "m02_average_installments_total": """
SELECT round(avg(k), 6) AS average_installments FROM (SELECT order_id, max(installments) AS k FROM c_payments GROUP BY 1)""",
    "m03_orders": _by_month("count(DISTINCT order_id) AS orders"),
    "m03_orders_by_category": """
SELECT category AS product_category_name, count(DISTINCT order_id) AS orders FROM bi_items GROUP BY 1""",
    "m03_orders_total": "SELECT count(DISTINCT order_id) AS orders FROM c_orders",
    "m04_revenue_by_delivery": """
SELECT ym AS year_month, round(sum(v), 2) AS revenue_by_delivery FROM delivery_months GROUP BY 1""",
    "m04_revenue_by_delivery_any_status": """
SELECT strftime(delivery, '%Y-%m') AS year_month, round(sum(price), 2) AS revenue_by_delivery FROM bi_items
WHERE delivery IS NOT NULL GROUP BY 1""",
    "m05_revenue_last_month": "SELECT year_month, round(cur, 2) AS revenue_last_month FROM cards WHERE cur IS NOT NULL",
    "m06_average_ticket": """
SELECT o.purchase_month AS year_month, round((SELECT sum(price) FROM bi_items i WHERE i.purchase_month = o.purchase_month)
       / count(DISTINCT order_id) + 1e-6, 4) AS average_ticket FROM c_orders o GROUP BY 1""",
    "m06_average_ticket_by_category": """
SELECT category AS product_category_name, round(sum(price) / count(DISTINCT order_id) + 1e-6, 4) AS average_ticket
FROM bi_items GROUP BY 1""",
    "m07_late_impact": f"""
SELECT * FROM (SELECT purchase_month AS year_month,
  round((({_TIME_SCORE}) - coalesce({_LATE_SCORE}, 0)) / {_TIME_SCORE}, 6) AS late_impact FROM bi_orders GROUP BY 1)
WHERE late_impact IS NOT NULL""",
    "m08_late_share": _by_month(f"round(nullif({_LATE}, 0) / {_DELIVERED}, 6) AS late_share", f"HAVING {_LATE} > 0"),
    "m08_late_share_by_state": f"""
SELECT raw_state AS customer_state, round({_LATE} / {_DELIVERED}, 6) AS late_share FROM bi_orders GROUP BY 1""",
    "m09_late_share_by_seller": f"""
SELECT seller_id, round({_LATE} / count(DISTINCT order_id), 6) AS late_share_by_seller FROM seller_orders_bi
GROUP BY 1 HAVING {_LATE} > 0""",
    "m10_on_time_share": _by_month(
        f"round({_ON_TIME} / {_DELIVERED}, 6) AS on_time_share", f"HAVING {_ON_TIME} > 0"
    ),
    "m11_negative_review_share": _by_month(
        "round(count(DISTINCT order_id) FILTER (WHERE lowest_score < 4) / count(DISTINCT order_id) "
        "FILTER (WHERE review_count > 0), 6) AS negative_review_share",
        "HAVING count(*) FILTER (WHERE lowest_score < 4) > 0",
    ),
    "m12_average_days_late": _by_month("round(avg(days_late), 6) AS average_days_late", "HAVING count(days_late) > 0"),
    "m13_stars": _by_month(_STARS.format("avg(review_score)") + " AS stars"),
    "m14_stars_late": _by_month(_STARS.format(_LATE_SCORE) + " AS stars_late"),
    "m15_stars_on_time": _by_month(_STARS.format(_TIME_SCORE) + " AS stars_on_time"),
    "m16_lead_approval_carrier": _by_month(
        "round(avg(d_carrier - d_approved), 6) AS lead_approval_carrier", "HAVING count(d_carrier - d_approved) > 0"
    ),
    "m17_lead_purchase_approval": _by_month("round(avg(d_approved - d_purchase), 6) AS lead_purchase_approval"),
    "m18_lead_purchase_delivery": _by_month(
        "round(avg(d_delivered - d_purchase) FILTER (WHERE is_delivered), 6) AS lead_purchase_delivery",
        "HAVING count(d_delivered) FILTER (WHERE is_delivered) > 0",
    ),
    "m19_lead_carrier_customer": _by_month(
        "round(avg(d_delivered - d_carrier), 6) AS lead_carrier_customer", "HAVING count(d_delivered) > 0"
    ),
    "m20_average_score": _by_month("round(avg(review_score), 6) AS average_score", "HAVING count(review_score) > 0"),
    "m20_average_score_by_category": """
SELECT category AS product_category_name, round(avg(review_score), 6) AS average_score
FROM (SELECT DISTINCT category, order_id, review_score FROM bi_items) GROUP BY 1""",
    "m21_average_score_late": _by_month(
        f"round({_LATE_SCORE}, 6) AS average_score_late", "HAVING count(review_score) FILTER (WHERE is_late) > 0"
    ),
    "m22_average_score_late_by_seller": f"""
SELECT seller_id, round({_LATE_SCORE}, 6) AS average_score_late_by_seller FROM seller_orders_bi GROUP BY 1
HAVING count(review_score) FILTER (WHERE is_late) > 0""",
    "m23_average_score_on_time": _by_month(
        f"round({_TIME_SCORE}, 6) AS average_score_on_time", "HAVING count(review_score) FILTER (WHERE is_on_time) > 0"
    ),
    "m24_average_score_by_seller": """
SELECT seller_id, round(avg(review_score), 6) AS average_score_by_seller FROM seller_orders_bi GROUP BY 1
HAVING count(review_score) > 0""",
    "m25_late_orders": _by_month(f"{_LATE} AS late_orders", f"HAVING {_LATE} > 0"),
    "m26_on_time_orders": _by_month(f"{_ON_TIME} AS on_time_orders", f"HAVING {_ON_TIME} > 0"),
    "m27_orders_by_seller": "SELECT seller_id, count(DISTINCT order_id) AS orders_by_seller FROM seller_orders_bi GROUP BY 1",
    "m28_seller_delay_rank": """
SELECT seller_id, dense_rank() OVER (ORDER BY s DESC) AS seller_delay_rank FROM (
SELECT seller_id, CAST(count(DISTINCT order_id) * sum(days_late) FILTER (WHERE is_delivered) AS DOUBLE) / count(days_late) FILTER (WHERE is_delivered) AS s
FROM seller_orders_bi GROUP BY 1) WHERE s > 0""",
    "m28_seller_delay_rank_by_month": """
SELECT ym AS year_month, seller_id, dense_rank() OVER (PARTITION BY ym ORDER BY s DESC) AS seller_delay_rank FROM (
SELECT purchase_month AS ym, seller_id, CAST(count(DISTINCT order_id) * sum(days_late) FILTER (WHERE is_delivered) AS DOUBLE) / count(days_late) FILTER (WHERE is_delivered) AS s
FROM seller_orders_bi GROUP BY 1, 2) WHERE s > 0""",
    "m29_returning_share": """
SELECT i.purchase_month AS year_month, round(count(DISTINCT i.customer_unique_id) /
  (SELECT count(DISTINCT o.customer_unique_id) FROM bi_orders o WHERE o.purchase_month = i.purchase_month), 6) AS returning_share
FROM bi_items i JOIN first_orders f USING (customer_unique_id)
WHERE strftime(f.first_purchase, '%Y-%m') < i.purchase_month GROUP BY 1""",
    "m30_returning_customers": _returning(False),
    "m30_returning_customers_by_category": _returning(True),
    "m31_new_customers": """
SELECT strftime(first_purchase, '%Y-%m') AS year_month, count(*) AS new_customers FROM first_orders GROUP BY 1""",
    "m32_unique_customers": _by_month("count(DISTINCT customer_unique_id) AS unique_customers"),
    "m32_unique_customers_by_category": """
SELECT category AS product_category_name, count(DISTINCT customer_unique_id) AS unique_customers FROM bi_items GROUP BY 1""",
    "m33_purchase_frequency": """
SELECT ym AS year_month, round(avg(n), 6) AS purchase_frequency FROM (
SELECT purchase_month AS ym, customer_unique_id, count(DISTINCT order_id) AS n FROM bi_orders GROUP BY 1, 2) GROUP BY 1""",
    "m33_purchase_frequency_total": """
SELECT round(avg(n), 6) AS purchase_frequency FROM (
SELECT customer_unique_id, count(DISTINCT order_id) AS n FROM bi_orders GROUP BY 1)""",
    "m34_items_sold": _by_month("count(*) AS items_sold", source="bi_items"),
    "m34_items_sold_by_category": "SELECT category AS product_category_name, count(*) AS items_sold FROM bi_items GROUP BY 1",
    "m35_items_of_recurring_customers": _recurring(False),
    "m35_items_of_recurring_customers_by_category": _recurring(True),
    "m36_revenue_previous_3_months": """
SELECT year_month, round(p3, 2) AS revenue_previous_3_months FROM windows3 WHERE p3 IS NOT NULL""",
    "m37_revenue_last_3_months": """
SELECT year_month, round(l3, 2) AS revenue_last_3_months FROM windows3 WHERE l3 IS NOT NULL""",
    "m38_revenue_trend": """
SELECT year_month, round((coalesce(l3, 0) - p3) / p3, 6) AS revenue_trend FROM windows3 WHERE p3 IS NOT NULL""",
    "m38_revenue_trend_by_category": """
SELECT year_month, product_category_name, round((coalesce(l3, 0) - p3) / p3, 6) AS revenue_trend FROM (
SELECT c.year_month, i.category AS product_category_name,
       sum(price) FILTER (WHERE d_purchase > c.month_end - INTERVAL 3 MONTH) AS l3,
       sum(price) FILTER (WHERE d_purchase <= c.month_end - INTERVAL 3 MONTH) AS p3
FROM cal_months c JOIN bi_items i ON d_purchase > c.month_end - INTERVAL 6 MONTH AND d_purchase <= c.month_end
GROUP BY 1, 2) WHERE p3 IS NOT NULL""",
    "m39_top_1_revenue": _podium_revenue(1),
    "m40_top_1_seller": _podium_alias(1),
    "m41_top_2_revenue": _podium_revenue(2),
    "m42_top_2_seller": _podium_alias(2),
    "m43_top_3_revenue": _podium_revenue(3),
    "m44_top_3_seller": _podium_alias(3),
    "m45_strategic_revenue_share": """
SELECT ym AS year_month, round(sum(v) FILTER (WHERE k <= 10) / sum(v), 6) AS strategic_revenue_share
FROM seller_month_rank GROUP BY 1""",
    "m45_strategic_revenue_share_total": """
SELECT round(sum(v) FILTER (WHERE k <= 10) / sum(v), 6) AS strategic_revenue_share FROM seller_rank""",
    "m46_projected_gain_share": """
SELECT late_reduction, repurchase_increase, seller_expansion, round((projected - base) / base, 6) AS projected_gain_share
FROM results""",
    "m47_forecast_baseline": "SELECT year_month, round(b, 2) AS forecast_baseline FROM forecast",
    "m48_forecast_simulated": """
SELECT year_month, late_reduction, repurchase_increase, seller_expansion, round(b * (1 + impact), 0) AS forecast_simulated
FROM forecast, grid""",
    "m49_shown_history": "SELECT ym AS year_month, round(v, 2) AS shown_revenue FROM month_sales, valid_month WHERE e <= m",
    "m50_projected_3_months": """
SELECT late_reduction, repurchase_increase, seller_expansion, round(projected, 0) AS projected_3_months FROM results""",
    "m51_simulation_text": """
SELECT late_reduction, repurchase_increase, seller_expansion,
 'Com redução de atraso de ' || late_reduction || '%, aumento de recompra de ' || repurchase_increase ||
 '% e expansão de sellers estratégicos de ' || seller_expansion ||
 '%, a receita projetada para os próximos 3 meses é de ' ||
 coalesce('R$ ' || format('{:,}', CAST(round(projected, 0) AS BIGINT)), '') || ', representando uma variação de ' ||
 coalesce(format('{:.1f}%', round((projected - base) / base * 100, 1)), '') || ' sobre o baseline.' AS simulation_text
FROM results""",
    "m52_projected_gain": """
SELECT late_reduction, repurchase_increase, seller_expansion, round(projected - base, 0) AS projected_gain FROM results""",
    "m54_late_orders_by_seller": f"""
SELECT seller_id, {_LATE} AS late_orders_by_seller FROM seller_orders_bi GROUP BY 1 HAVING {_LATE} > 0""",
    "m55_delivered_orders": _by_month(f"{_DELIVERED} AS delivered_orders", f"HAVING {_DELIVERED} > 0"),
    "m56_baseline_3_months": "SELECT round(base, 2) AS baseline_3_months FROM baseline3",
    "m57_base_revenue_3m": "SELECT round(b, 2) AS base_revenue_3m FROM base3",
    "m58_revenue_previous_month": """
SELECT year_month, round(prev, 2) AS revenue_previous_month FROM cards WHERE prev IS NOT NULL""",
    "m59_product_revenue": _by_month("round(sum(price), 2) AS product_revenue", source="bi_items"),
    "m59_product_revenue_by_state": """
SELECT raw_state AS customer_state, round(sum(price), 2) AS product_revenue FROM bi_items GROUP BY 1""",
    "m59_product_revenue_by_category_in_asia": """
SELECT category AS product_category_name, round(sum(price), 2) AS product_revenue FROM bi_items
WHERE raw_state = 'ASIA' GROUP BY 1""",
    "m60_strategic_revenue": """
SELECT ym AS year_month, round(sum(v), 2) AS strategic_revenue FROM seller_month_rank WHERE k <= 10 GROUP BY 1""",
    "m60_strategic_revenue_by_seller": """
SELECT seller_id, round(v, 2) AS strategic_revenue FROM seller_rank WHERE k <= 10""",
    "m61_delay_score": """
SELECT seller_id, round(CAST(count(DISTINCT order_id) * sum(days_late) FILTER (WHERE is_delivered) AS DOUBLE) / count(days_late) FILTER (WHERE is_delivered), 6) AS delay_score
FROM seller_orders_bi GROUP BY 1""",
    "m62_last_valid_month": "SELECT m AS last_valid_month FROM valid_month",
    "m63_last_real_date": "SELECT max(purchase) AS last_real_date FROM c_orders",
    "m64_last_real_month": "SELECT m AS last_real_month FROM real_month",
}


def _wrap(sql: str) -> str:
    """A query that opens with its own WITH keeps it as a further clause."""
    text = sql.strip()
    if not text.startswith("WITH "):
        return with_ctes(text)
    full = with_ctes(text)
    head, own = full.split("\nWITH ", 1)
    return f"{head},\n{own}"


ORACLES: dict[str, str] = {name: _wrap(sql) for name, sql in (_RAW | INFERENCE | SLICERS).items()}
ORACLES["negative_review_logit"] = ORACLES["negative_review_logit"].replace("WITH ", "WITH RECURSIVE ", 1)
ORACLES["kpi_summary"] = _kpi_query(_KPI_SELECT)
ORACLES["kpi_text"] = _kpi_query(_KPI_TEXT)
