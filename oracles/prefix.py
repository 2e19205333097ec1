"""Common table expressions shared by the oracle queries (DuckDB SQL)."""

from __future__ import annotations

import re

# name -> (body, names it reads). Only what a query needs is put in its WITH clause.
CTES: dict[str, str] = {
    "places": """
SELECT n_nationkey, n_name AS city, r_name AS state FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""",
    "c_customers": """
SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id, city AS raw_city, state AS raw_state,
       upper(city[1]) || lower(city[2:]) AS customer_city, upper(state) AS customer_state
FROM customer LEFT JOIN places ON c_nationkey = n_nationkey""",
    "c_sellers": """
SELECT s_suppkey AS seller_id, city AS raw_city, state AS raw_state,
       upper(city[1]) || lower(city[2:]) AS seller_city, upper(state) AS seller_state
FROM supplier LEFT JOIN places ON s_nationkey = n_nationkey""",
    "c_orders": """
SELECT o_orderkey AS order_id, o_custkey AS customer_id,
       CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'processing' END AS order_status,
       o_orderdate AS purchase, o_orderdate + INTERVAL 1 DAY AS approved, s.first_ship AS carrier,
       s.last_ship AS delivery, o_orderdate + INTERVAL 730 DAY AS estimated,
       strftime(o_orderdate, '%Y-%m') AS purchase_month
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
                       FROM lineitem GROUP BY 1) s ON o_orderkey = s.l_orderkey""",
    "c_items": """
SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
       l_extendedprice AS price, l_extendedprice * l_tax + 0.0 AS freight_value, p_brand AS category
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
    "c_payments": """
SELECT l_orderkey AS order_id, 1 + CAST(trunc(l_quantity) AS INTEGER) % 12 AS installments
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "c_reviews": """
SELECT event_id // 2 AS order_id, CAST(1 + CAST(floor(value) AS BIGINT) % 5 AS DOUBLE) AS review_score FROM events""",
    "reviews": """
SELECT order_id, avg(review_score) AS review_score, count(*) AS review_count, min(review_score) AS lowest_score
FROM c_reviews GROUP BY 1""",
    "delivered_all": """
SELECT * FROM c_orders WHERE order_status = 'delivered' AND delivery IS NOT NULL AND purchase IS NOT NULL""",
    "delivered": """
SELECT *, CAST(delivery AS DATE) AS reference_date, CAST(date_trunc('month', delivery) AS DATE) AS month,
       strftime(delivery, '%Y-%m') AS year_month, estimated IS NOT NULL AS valid, delivery > estimated AS is_delayed,
       greatest(0.0, date_diff('microsecond', estimated, delivery) / 86400e6) AS delay_days,
       greatest(0.0, date_diff('microsecond', purchase, delivery) / 86400e6) AS lead_time_days
FROM delivered_all
WHERE delivery >= TIMESTAMP '1995-01-01' AND delivery < TIMESTAMP '2001-12-01'""",
    "order_sales": """
SELECT order_id, sum(price) AS order_revenue, count(*) AS item_count, count(DISTINCT seller_id) AS seller_count,
       count(DISTINCT product_id) AS product_count FROM c_items GROUP BY 1""",
    "order_level": """
SELECT d.*, s.* EXCLUDE (order_id), c.customer_unique_id, c.customer_city, c.customer_state, r.review_score,
       r.review_count,
       row_number() OVER (PARTITION BY c.customer_unique_id ORDER BY d.purchase, d.order_id) AS seq,
       count(*) OVER (PARTITION BY c.customer_unique_id) AS customer_total
FROM delivered d JOIN order_sales s USING (order_id) LEFT JOIN c_customers c USING (customer_id)
LEFT JOIN reviews r USING (order_id)""",
    "threshold": """
SELECT count(*) FILTER (WHERE review_score <= 2) AS negative_reviews,
       CASE WHEN count(*) FILTER (WHERE review_score <= 2) < 30 THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END AS t
FROM order_level""",
    "translated": """
SELECT p_brand AS category, CASE WHEN CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) <= 20
       THEN lower(replace(p_brand, '#', '_')) ELSE p_brand END AS final FROM part GROUP BY ALL""",
    "item_level": """
SELECT i.*, coalesce(t.final, 'unknown') AS product_category_final, d.reference_date, d.month, d.year_month,
       c.customer_unique_id, c.customer_city, c.customer_state, s.seller_city, s.seller_state
FROM c_items i JOIN delivered d USING (order_id) LEFT JOIN c_customers c USING (customer_id)
LEFT JOIN translated t USING (category) LEFT JOIN c_sellers s USING (seller_id)""",
    "seller_order": """
SELECT g.*, s.seller_city, s.seller_state, o.purchase, o.delivery, o.month, o.year_month, o.valid, o.is_delayed, o.delay_days,
       o.lead_time_days, o.review_score, o.review_count
FROM (SELECT order_id, seller_id, sum(price) AS revenue, count(*) AS items, count(DISTINCT product_id) AS products
      FROM item_level GROUP BY 1, 2) g
LEFT JOIN c_sellers s USING (seller_id) LEFT JOIN order_level o USING (order_id)""",
    "raw_bounds": """
SELECT min(delivery) AS first_at, max(delivery) AS last_at,
       CAST(date_trunc('month', min(delivery)) AS DATE) AS first_month,
       CAST(date_trunc('month', max(delivery)) AS DATE) AS last_month FROM order_level""",
    "cut_bounds": """
SELECT *, CASE WHEN day(first_at) <> 1 THEN CAST(first_month + INTERVAL 1 MONTH AS DATE) ELSE first_month END AS s0,
       CASE WHEN CAST(last_at AS DATE) <> last_day(last_at) THEN CAST(last_month - INTERVAL 1 MONTH AS DATE)
            ELSE last_month END AS e0 FROM raw_bounds""",
    "bounds": """
SELECT least(CASE WHEN s0 > e0 THEN first_month ELSE s0 END, DATE '1995-01-01') AS s,
       CASE WHEN s0 > e0 THEN last_month ELSE e0 END AS e,
       CASE WHEN s0 > e0 THEN '' ELSE concat_ws(', ',
         CASE WHEN s0 <> first_month AND NOT (s0 > DATE '1995-01-01' AND strftime(first_month, '%Y-%m') = '1995-01')
              THEN strftime(first_month, '%Y-%m') END,
         CASE WHEN e0 <> last_month THEN strftime(last_month, '%Y-%m') END) END AS dropped
FROM cut_bounds""",
    "daily": """
SELECT reference_date AS purchase_date, sum(order_revenue) AS daily_revenue, count(DISTINCT order_id) AS daily_orders
FROM order_level GROUP BY 1""",
    "monthly_raw": """
SELECT month, year_month, sum(order_revenue) AS revenue_month, count(DISTINCT order_id) AS orders_month,
       avg(order_revenue) AS avg_ticket_month, count(DISTINCT customer_unique_id) AS unique_customers,
       count(DISTINCT order_id) FILTER (WHERE valid) AS delivered_orders_valid,
       count(*) FILTER (WHERE valid AND is_delayed) AS delayed_orders,
       avg(delay_days) FILTER (WHERE valid) AS avg_delay_days,
       avg(lead_time_days) FILTER (WHERE valid) AS avg_lead_time_days, avg(review_score) AS avg_review_score,
       avg(CASE WHEN review_score IS NULL THEN NULL WHEN review_score <= (SELECT t FROM threshold) THEN 1.0 ELSE 0.0 END)
         AS negative_review_rate,
       nullif(count(review_score), 0) AS review_count,
       count(DISTINCT customer_unique_id) FILTER (WHERE seq = 1) AS new_customers,
       count(DISTINCT customer_unique_id) FILTER (WHERE seq > 1) AS repurchase_customers,
       avg(CASE WHEN seq > 1 THEN 1.0 ELSE 0.0 END) AS repurchase_order_rate
FROM order_level GROUP BY 1, 2""",
    "monthly": """
SELECT m.*, delayed_orders / nullif(delivered_orders_valid, 0) AS late_rate,
       repurchase_customers / nullif(unique_customers, 0) AS repurchase_customer_rate,
       (revenue_month / lag(revenue_month) OVER w - 1) * 100 AS revenue_mom_pct,
       (orders_month / lag(orders_month) OVER w - 1) * 100 AS orders_mom_pct,
       (avg_ticket_month / lag(avg_ticket_month) OVER w - 1) * 100 AS ticket_mom_pct
FROM monthly_raw m, bounds b WHERE m.month BETWEEN b.s AND b.e WINDOW w AS (ORDER BY month)""",
    "reviewed": """
SELECT * FROM order_level WHERE valid AND review_score IS NOT NULL""",
    "review_gap": """
SELECT avg(review_score) AS general, avg(review_score) FILTER (WHERE NOT is_delayed) AS on_time,
       avg(review_score) FILTER (WHERE is_delayed) AS late, avg(delay_days) AS delay, count(*) AS n FROM reviewed""",
    "risk": """
SELECT seller_id, count(DISTINCT order_id) AS seller_orders, sum(revenue) AS seller_revenue,
       count(*) FILTER (WHERE is_delayed) AS delayed_orders, avg(delay_days) AS avg_delay_days,
       avg(lead_time_days) AS avg_lead_time_days, avg(review_score) AS avg_review_score,
       avg(review_score) FILTER (WHERE is_delayed) AS avg_late_review_score,
       avg(review_score) FILTER (WHERE NOT is_delayed) AS avg_on_time_review_score
FROM seller_order WHERE valid GROUP BY 1""",
    "risk_scored": """
SELECT *, delayed_orders / seller_orders AS late_rate,
       greatest(0, coalesce(avg_on_time_review_score - avg_late_review_score,
                            (SELECT coalesce(on_time - late, 0) FROM review_gap))) AS impact_on_review,
       seller_orders * (delayed_orders / seller_orders) *
       greatest(0, coalesce(avg_on_time_review_score - avg_late_review_score,
                            (SELECT coalesce(on_time - late, 0) FROM review_gap))) AS risk_score
FROM risk""",
    "customer_summary": """
SELECT customer_unique_id, count(DISTINCT order_id) AS customer_orders, sum(order_revenue) AS customer_revenue,
       avg(order_revenue) AS avg_order_value, min(purchase) AS first_purchase,
       count(DISTINCT order_id) > 1 AS has_repurchase FROM order_level GROUP BY 1""",
    "performance": """
SELECT *, r * 0.5 AS rw, o * 0.3 AS ow, i * 0.2 AS iw, r * 0.5 + o * 0.3 + i * 0.2 AS score FROM (
SELECT *, (rank() OVER (ORDER BY total_revenue) + (count(*) OVER (PARTITION BY total_revenue) - 1) / 2.0) / count(*) OVER () AS r,
       (rank() OVER (ORDER BY total_orders) + (count(*) OVER (PARTITION BY total_orders) - 1) / 2.0) / count(*) OVER () AS o,
       (rank() OVER (ORDER BY total_items) + (count(*) OVER (PARTITION BY total_items) - 1) / 2.0) / count(*) OVER () AS i
FROM (SELECT seller_id, sum(revenue) AS total_revenue, count(DISTINCT order_id) AS total_orders,
             CAST(sum(items) AS BIGINT) AS total_items FROM seller_order GROUP BY 1))""",
    "strategic_flag": """
SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, total_revenue DESC, seller_id) <= 10 AS strategic FROM performance""",
    "strategic_month": """
SELECT month, year_month, sum(mv) AS total_revenue, CAST(sum(mn) AS BIGINT) AS total_orders,
       CAST(sum(mi) AS BIGINT) AS total_items,
       coalesce(sum(mv) FILTER (WHERE strategic), 0) AS strategic_revenue,
       CAST(coalesce(sum(mn) FILTER (WHERE strategic), 0) AS BIGINT) AS strategic_orders,
       CAST(coalesce(sum(mi) FILTER (WHERE strategic), 0) AS BIGINT) AS strategic_items
FROM (SELECT month, year_month, seller_id, sum(revenue) AS mv, count(DISTINCT order_id) AS mn, sum(items) AS mi
      FROM seller_order GROUP BY 1, 2, 3) JOIN strategic_flag USING (seller_id) GROUP BY 1, 2""",
    "strategic_series": """
SELECT m.*, strategic_revenue / nullif(total_revenue, 0) AS strategic_revenue_share,
       strategic_orders / nullif(total_orders, 0) AS strategic_orders_share
FROM strategic_month m, bounds b WHERE month BETWEEN b.s AND b.e""",
    "enriched": """
SELECT m.*, coalesce(s.strategic_revenue_share, 0) AS strategic_revenue_share,
       coalesce(s.strategic_orders_share, 0) AS strategic_orders_share, s.strategic_revenue, s.strategic_orders
FROM monthly m LEFT JOIN strategic_series s USING (month)""",
    "drivers": """
SELECT *, (next_month_revenue / revenue_month - 1) * 100 AS growth FROM (
SELECT month, year_month, revenue_month, late_rate * 100 AS late_rate_pct,
       repurchase_customer_rate * 100 AS repurchase_customer_rate_pct,
       strategic_revenue_share * 100 AS strategic_revenue_share_pct,
       lead(revenue_month) OVER (ORDER BY month) AS next_month_revenue,
       lead(year_month) OVER (ORDER BY month) AS next_month_label FROM enriched)""",
    # ------------------------------------------------------------ dashboard
    "bi_orders": """
SELECT o.*, c.customer_unique_id, c.raw_state, r.review_score, r.review_count, r.lowest_score,
       CAST(purchase AS DATE) AS d_purchase, CAST(approved AS DATE) AS d_approved, CAST(carrier AS DATE) AS d_carrier,
       CAST(delivery AS DATE) AS d_delivered, CAST(estimated AS DATE) AS d_estimated,
       order_status = 'delivered' AS is_delivered,
       coalesce(order_status = 'delivered' AND CAST(delivery AS DATE) > CAST(estimated AS DATE), FALSE) AS is_late,
       coalesce(order_status = 'delivered' AND CAST(delivery AS DATE) <= CAST(estimated AS DATE), FALSE) AS is_on_time,
       CASE WHEN delivery IS NOT NULL AND estimated IS NOT NULL
            THEN greatest(0, date_diff('day', CAST(estimated AS DATE), CAST(delivery AS DATE))) END AS days_late
FROM c_orders o LEFT JOIN c_customers c USING (customer_id) LEFT JOIN reviews r USING (order_id)""",
    "bi_items": """
SELECT i.*, o.* EXCLUDE (order_id) FROM c_items i JOIN bi_orders o USING (order_id)""",
    "seller_orders_bi": """
SELECT DISTINCT seller_id, o.* FROM c_items JOIN bi_orders o USING (order_id)""",
    "cal": """
SELECT CAST(unnest(generate_series(DATE '1995-01-01',
       last_day(CAST((SELECT max(o_orderdate) FROM orders) AS DATE) + INTERVAL 6 MONTH), INTERVAL 1 DAY)) AS DATE) AS d""",
    "cal_months": """
SELECT strftime(d, '%Y-%m') AS year_month, min(d) AS month_start, max(d) AS month_end FROM cal GROUP BY 1""",
    "delivery_months": """
SELECT strftime(delivery, '%Y-%m') AS ym, raw_state AS state, sum(price) AS v
FROM bi_items WHERE is_delivered AND delivery IS NOT NULL GROUP BY 1, 2""",
    "cards": """
SELECT c.year_month, sum(a.v) AS cur,
       (SELECT sum(p.v) FROM delivery_months p
        WHERE p.ym = strftime(c.month_start - INTERVAL 1 MONTH, '%Y-%m')) AS prev
FROM cal_months c LEFT JOIN delivery_months a ON a.ym = c.year_month GROUP BY c.year_month, c.month_start""",
    "first_orders": """
SELECT customer_unique_id, min(purchase) AS first_purchase FROM bi_orders GROUP BY 1""",
    "windows3": """
SELECT c.year_month,
       (SELECT sum(price) FROM bi_items WHERE d_purchase > c.month_end - INTERVAL 3 MONTH
          AND d_purchase <= c.month_end) AS l3,
       (SELECT sum(price) FROM bi_items WHERE d_purchase > c.month_end - INTERVAL 6 MONTH
          AND d_purchase <= c.month_end - INTERVAL 3 MONTH) AS p3
FROM cal_months c""",
    "podium_base": """
SELECT seller_id, sum(price) AS v, count(DISTINCT order_id) AS n, count(*) AS i FROM c_items
WHERE order_id IN (SELECT order_id FROM c_orders) GROUP BY 1""",
    "podium": """
SELECT *, rank() OVER (ORDER BY score, v DESC) AS place FROM (
SELECT *, dense_rank() OVER (ORDER BY v DESC) + dense_rank() OVER (ORDER BY n DESC)
          + dense_rank() OVER (ORDER BY i DESC) AS score FROM podium_base)""",
    "aliases": """
SELECT seller_id, 'Seller #' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS alias
FROM (SELECT seller_id, dense_rank() OVER (ORDER BY seller_id) AS k FROM c_sellers)""",
    "valid_month": """
SELECT max(e) AS m FROM (
SELECT last_day(d) AS e, count(DISTINCT d) AS n FROM (SELECT CAST(purchase AS DATE) AS d FROM c_orders)
GROUP BY 1 HAVING count(DISTINCT d) >= day(last_day(d)) * 0.8::DOUBLE)""",
    "real_month": """
SELECT last_day(max(purchase)) AS m FROM c_orders""",
    "month_sales": """
SELECT purchase_month AS ym, last_day(min(d_purchase)) AS e, sum(price) AS v FROM bi_items GROUP BY 1""",
    "base3": """
SELECT avg(v) AS b FROM month_sales, valid_month
WHERE e <= m AND e > last_day(m - INTERVAL 3 MONTH)""",
    "forecast": """
SELECT year_month, month_end, b FROM cal_months, base3, valid_month
WHERE month_end > m AND month_end <= last_day(m + INTERVAL 3 MONTH)""",
    "grid": """
SELECT CAST(a AS INTEGER) AS late_reduction, CAST(b AS INTEGER) AS repurchase_increase, CAST(c AS INTEGER) AS seller_expansion,
       (1 + a / 100.0::DOUBLE * 0.1::DOUBLE) * (1 + b / 100.0::DOUBLE * 0.1::DOUBLE)
         * (1 + c / 100.0::DOUBLE * 0.8::DOUBLE) - 1 AS impact
FROM range(31) x(a), range(21) y(b), range(21) z(c)""",
    "baseline3": """
SELECT sum(b) AS base FROM forecast, real_month r
WHERE month_end > r.m AND month_end <= last_day(r.m + INTERVAL 3 MONTH)""",
    "results": """
SELECT g.*, base, base * (1 + impact) AS projected FROM grid g, baseline3""",
    "seller_month_rank": """
SELECT purchase_month AS ym, seller_id, v, row_number() OVER (PARTITION BY purchase_month ORDER BY v DESC, seller_id) AS k
FROM (SELECT purchase_month, seller_id, round(sum(price), 2) AS v FROM bi_items GROUP BY 1, 2)""",
    "seller_rank": """
SELECT seller_id, v, row_number() OVER (ORDER BY v DESC, seller_id) AS k
FROM (SELECT seller_id, round(sum(price), 2) AS v FROM bi_items GROUP BY 1)""",
}

_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def with_ctes(sql: str) -> str:
    """Prepend the WITH clause of every expression ``sql`` reads, in order."""
    needed: set[str] = set()
    queue = [sql]
    while queue:
        for word in set(_WORD.findall(queue.pop())):
            if word in CTES and word not in needed:
                needed.add(word)
                queue.append(CTES[word])
    clauses = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in CTES if name in needed)
    return f"WITH {clauses}\n{sql.strip()}" if clauses else sql.strip()
