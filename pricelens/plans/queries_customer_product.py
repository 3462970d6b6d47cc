"""Registered queries: customer (U1-U4) and product (D1-D4) analyses."""

from __future__ import annotations

from ..operators import customer, product
from .oracle_base import b2, b3, fine_mean, lines, margin_pct, msum, newest, with_base
from .registry import WHOLE, register


def _q(*ctes: str, select: str) -> str:
    return with_base("".join(", " + c for c in ctes) + "\n" + select)


_L = f"l AS (SELECT * FROM fact WHERE {lines(returns=False, samples=False)})"
_DATES = "d AS (SELECT customer_code, min(invoice_date) AS first_date, max(invoice_date) AS last_date FROM l GROUP BY customer_code)"
_RANK_C = "total_revenue DESC NULLS LAST, customer_code, customer_name"

# --- U1 -------------------------------------------------------------------------------
_U1 = (b2("b", returns=False, samples=False), _L, _DATES, f"""items AS (
  SELECT t.customer_code, t.customer_name, coalesce(d.first_date, '') AS first_purchase_date,
         coalesce(d.last_date, '') AS last_purchase_date,
         greatest(1, coalesce(date_diff('day', CAST(d.first_date AS DATE), CAST(d.last_date AS DATE)), 1)) AS customer_age_days,
         t.total_revenue, t.total_revenue - t.total_cost AS total_margin, t.transaction_count AS total_transactions,
         t.total_revenue / t.transaction_count AS avg_order_value,
         t.transaction_count / greatest(1, coalesce(date_diff('day', CAST(d.first_date AS DATE), CAST(d.last_date AS DATE)), 1)) * 30
           AS purchase_frequency_per_month
  FROM b t LEFT JOIN d ON t.customer_code = d.customer_code)""")


@register("u1_lifetime_value", _q(*_U1, select="SELECT * FROM items"))
def u1_lifetime_value(e):
    return customer.lifetime_value(e.fact, WHOLE).items


@register("u1_lifetime_value_summary", _q(*_U1, select=f"""
SELECT count(*) AS total_customers, coalesce(coalesce({msum('total_revenue')}, 0e0) / count(*), 0e0) AS avg_lifetime_value,
       coalesce({msum('total_revenue')}, 0e0) AS total_revenue FROM items"""))
def u1_lifetime_value_summary(e):
    return customer.lifetime_value(e.fact, WHOLE).summary


# --- U2 -------------------------------------------------------------------------------
_U2 = (b2("b", returns=False, samples=False), f"""top AS (
  SELECT customer_code, customer_name, total_revenue, total_revenue - total_cost AS margin,
         {margin_pct('total_revenue', 'total_cost')} AS margin_percent
  FROM b),
r AS (SELECT *, row_number() OVER (ORDER BY {_RANK_C}) AS rank,
             row_number() OVER (ORDER BY margin_percent DESC NULLS LAST, customer_code, customer_name) AS mrank,
             count(*) OVER () AS n FROM top),
th AS (SELECT coalesce(max(CASE WHEN rank = floor(n * 0.33e0) + 1 THEN total_revenue END), 0e0) AS rp67,
              coalesce(max(CASE WHEN rank = floor(n * 0.67e0) + 1 THEN total_revenue END), 0e0) AS rp33,
              coalesce(max(CASE WHEN mrank = floor(n * 0.33e0) + 1 THEN margin_percent END), 0e0) AS mp67,
              coalesce(max(CASE WHEN mrank = floor(n * 0.67e0) + 1 THEN margin_percent END), 0e0) AS mp33 FROM r),
seg AS (SELECT r.*,
   CASE WHEN total_revenue >= rp67 THEN 'high' WHEN total_revenue >= rp33 THEN 'medium' ELSE 'low' END AS revenue_segment,
   CASE WHEN margin_percent >= mp67 THEN 'high' WHEN margin_percent >= mp33 THEN 'medium' ELSE 'low' END AS margin_segment
   FROM r, th)""")


@register("u2_segmentation", _q(*_U2, select="""
SELECT customer_code, customer_name, total_revenue AS revenue, margin, margin_percent, revenue_segment, margin_segment,
       revenue_segment || '_revenue_' || margin_segment || '_margin' AS combined_segment
FROM seg WHERE rank <= 20"""))
def u2_segmentation(e):
    return customer.segmentation(e.fact, WHOLE).items


@register("u2_segmentation_summary", _q(*_U2, select="""
SELECT count(*) AS total_customers, count(CASE WHEN revenue_segment = 'high' THEN 1 END) AS high_value_count,
       count(CASE WHEN revenue_segment = 'medium' THEN 1 END) AS medium_value_count,
       count(CASE WHEN revenue_segment = 'low' THEN 1 END) AS low_value_count FROM seg"""))
def u2_segmentation_summary(e):
    return customer.segmentation(e.fact, WHOLE).summary


# --- U3 -------------------------------------------------------------------------------
_U3 = (b2("b", returns=False, samples=False), _L, _DATES, f"""top AS (SELECT * FROM b),
sc AS (
  SELECT t.customer_code, t.customer_name, coalesce(d.last_date, '1970-01-01') AS last_purchase_date,
         date_diff('day', CAST(coalesce(d.last_date, '1970-01-01') AS DATE), DATE '2001-08-01') AS days_since_last_purchase,
         t.total_revenue AS lifetime_revenue, t.total_revenue - t.total_cost AS lifetime_margin
  FROM top t LEFT JOIN d ON t.customer_code = d.customer_code),
sc2 AS (SELECT *, CASE WHEN days_since_last_purchase > 90 THEN
                        CASE WHEN lifetime_revenue > 10000 THEN 'high' ELSE 'medium' END ELSE 'low' END AS risk_level
        FROM sc),
risk AS (SELECT *, CASE WHEN risk_level = 'high' THEN 'High-value customer inactive for ' || days_since_last_purchase || ' days'
                        WHEN risk_level = 'medium' THEN 'Inactive for ' || days_since_last_purchase || ' days'
                        ELSE 'Active customer' END AS risk_reason
         FROM sc2 WHERE risk_level <> 'low')""")


@register("u3_churn_risk", _q(*_U3, select="""
SELECT * FROM risk ORDER BY (risk_level = 'high') DESC, lifetime_revenue DESC NULLS LAST, customer_code, customer_name
LIMIT 20"""))
def u3_churn_risk(e):
    return customer.churn_risk(e.fact, WHOLE).items


@register("u3_churn_risk_summary", _q(*_U3, select=f"""
SELECT (SELECT count(*) FROM top) AS total_customers_analyzed,
       count(CASE WHEN risk_level = 'high' THEN 1 END) AS high_risk_count,
       count(CASE WHEN risk_level = 'medium' THEN 1 END) AS medium_risk_count,
       coalesce({msum('lifetime_revenue')}, 0e0) AS at_risk_revenue FROM risk"""))
def u3_churn_risk_summary(e):
    return customer.churn_risk(e.fact, WHOLE).summary


# --- U4 -------------------------------------------------------------------------------
_U4 = (b2("b", returns=False, samples=False), f"""top AS (
  SELECT customer_code, customer_name, total_revenue, row_number() OVER (ORDER BY {_RANK_C}) AS rank
  FROM b),
tot AS (SELECT coalesce({msum('total_revenue')}, 0e0) AS total FROM top),
sh AS (SELECT top.*, tot.total, total_revenue / total * 100 AS revenue_percent,
              CAST(SUM(CAST(total_revenue AS DECIMAL(38,6))) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
                / total * 100 AS cumulative_percent
       FROM top, tot)""")


@register("u4_concentration", _q(*_U4, select="""
SELECT rank, customer_code, customer_name, total_revenue AS revenue, revenue_percent, cumulative_percent
FROM sh WHERE rank <= 20"""))
def u4_concentration(e):
    return customer.concentration(e.fact, WHOLE).items


@register("u4_concentration_summary", _q(*_U4, select=f"""
SELECT total_customers, total_revenue, top10_revenue, top20_revenue, customers_for_80_percent_revenue,
       top10_revenue / total_revenue * 100 AS top10_percent, top20_revenue / total_revenue * 100 AS top20_percent
FROM (SELECT count(*) AS total_customers, first(total) AS total_revenue,
             coalesce({msum('CASE WHEN rank <= 10 THEN total_revenue END')}, 0e0) AS top10_revenue,
             coalesce({msum('CASE WHEN rank <= 20 THEN total_revenue END')}, 0e0) AS top20_revenue,
             CAST(coalesce(min(CASE WHEN cumulative_percent >= 80 THEN rank END), count(*)) AS BIGINT)
               AS customers_for_80_percent_revenue
      FROM sh)"""))
def u4_concentration_summary(e):
    return customer.concentration(e.fact, WHOLE).summary


# --- D1 -------------------------------------------------------------------------------
_MONTHS = "greatest(1e0, date_diff('day', DATE '1995-01-01', DATE '2001-08-01') / 30e0)"
_D1 = (b3("b", returns=False, samples=False), _L, f"""top AS (SELECT * FROM b),
last AS (SELECT item_code, max(invoice_date) AS last_date FROM l GROUP BY item_code),
sc AS (
  SELECT t.item_code, t.product_description, t.transaction_count, t.total_quantity AS total_quantity_sold,
         t.total_quantity / {_MONTHS} AS avg_monthly_sales, coalesce(last.last_date, '1995-01-01') AS last_sale_date,
         date_diff('day', CAST(coalesce(last.last_date, '1995-01-01') AS DATE), DATE '2001-08-01') AS days_since_last_sale,
         t.landed_cost_euro AS landed_cost
  FROM top t LEFT JOIN last ON t.item_code = last.item_code
  WHERE t.total_quantity / {_MONTHS} <= 2)""")


@register("d1_slow_movers", _q(*_D1, select="SELECT * FROM sc ORDER BY transaction_count ASC NULLS LAST, item_code LIMIT 20"))
def d1_slow_movers(e):
    return product.slow_movers(e.fact, WHOLE).items


@register("d1_slow_movers_summary", _q(*_D1, select=f"""
SELECT (SELECT count(*) FROM top) AS total_products, count(*) AS slow_moving_count,
       coalesce({msum('landed_cost * total_quantity_sold')}, 0e0) AS total_value_at_risk FROM sc"""))
def d1_slow_movers_summary(e):
    return product.slow_movers(e.fact, WHOLE).summary


# --- D2 -------------------------------------------------------------------------------
_D2 = (b3("b", returns=True, samples=False), f"""top AS (
  SELECT *, row_number() OVER (ORDER BY total_revenue DESC NULLS LAST, item_code) AS rank
  FROM b),
tot AS (SELECT coalesce({msum('total_revenue')}, 0e0) AS total,
               coalesce({msum('total_revenue - total_cost')}, 0e0) AS total_margin FROM top),
an AS (
  SELECT rank, item_code, product_description, total_revenue AS revenue, total_revenue / total * 100 AS revenue_percent,
         total_revenue - total_cost AS margin, {margin_pct('total_revenue', 'total_cost')} AS margin_percent,
         CAST(SUM(CAST(total_revenue AS DECIMAL(38,6))) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
           / total * 100 AS cumulative_revenue_percent, total, total_margin
  FROM top, tot),
an2 AS (SELECT *, CASE WHEN cumulative_revenue_percent <= 80 THEN 'A' WHEN cumulative_revenue_percent <= 95 THEN 'B'
                      ELSE 'C' END AS abc_classification FROM an)""")


@register("d2_product_mix", _q(*_D2, select="""
SELECT item_code, product_description, revenue, revenue_percent, margin, margin_percent, cumulative_revenue_percent,
       abc_classification FROM an2 WHERE rank <= 20"""))
def d2_product_mix(e):
    return product.product_mix(e.fact, WHOLE).items


@register("d2_product_mix_summary", _q(*_D2, select="""
SELECT count(*) AS total_products, first(total) AS total_revenue, first(total_margin) AS total_margin,
       count(CASE WHEN abc_classification = 'A' THEN 1 END) AS a_class_count,
       count(CASE WHEN abc_classification = 'B' THEN 1 END) AS b_class_count,
       count(CASE WHEN abc_classification = 'C' THEN 1 END) AS c_class_count FROM an2"""))
def d2_product_mix_summary(e):
    return product.product_mix(e.fact, WHOLE).summary


# --- D3 (min co-occurrence 2: the default 5 leaves almost no pair in the fixtures) ----
_D3 = (_L, newest("item_description", "item_code", "l", "nd"), """bi AS (SELECT DISTINCT invoice_number, customer_code, item_code FROM l),
pairs AS (
  SELECT a.item_code AS product_a_code, b.item_code AS product_b_code, count(*) AS co_occurrence_count,
         count(DISTINCT a.customer_code) + max(CASE WHEN a.customer_code IS NULL THEN 1 ELSE 0 END) AS customers_buying_both
  FROM bi a JOIN bi b ON a.invoice_number = b.invoice_number AND a.customer_code IS NOT DISTINCT FROM b.customer_code
   AND a.item_code < b.item_code
  GROUP BY a.item_code, b.item_code HAVING count(*) >= 2),
per_item AS (SELECT l.item_code, count(*) AS n, coalesce(nd.newest_value, '') AS descr
             FROM l JOIN nd ON l.item_code IS NOT DISTINCT FROM nd.item_code GROUP BY l.item_code, nd.newest_value),
sc AS (
  SELECT p.product_a_code, pa.descr AS product_a_description, p.product_b_code, pb.descr AS product_b_description,
         p.co_occurrence_count, p.customers_buying_both, p.co_occurrence_count / pa.n * 100 AS confidence,
         p.co_occurrence_count / pb.n * 100 AS confidence_b_to_a
  FROM pairs p JOIN per_item pa ON p.product_a_code = pa.item_code JOIN per_item pb ON p.product_b_code = pb.item_code)""")


@register("d3_cross_sell", _q(*_D3, select="""
SELECT * FROM sc ORDER BY co_occurrence_count DESC NULLS LAST, product_a_code, product_b_code LIMIT 20"""))
def d3_cross_sell(e):
    return product.cross_sell(e.fact, WHOLE, min_co_occurrence=2).items


@register("d3_cross_sell_summary", _q(*_D3, select=f"""
SELECT count(*) AS qualifying_pairs, coalesce({fine_mean('confidence')}, 0e0) AS avg_confidence FROM sc"""))
def d3_cross_sell_summary(e):
    return product.cross_sell(e.fact, WHOLE, min_co_occurrence=2).summary


@register("d3_cross_sell_total_pairs", _q(_L, """bi AS (SELECT DISTINCT invoice_number, customer_code, item_code FROM l)""",
                                          select="""
SELECT count(*) AS total_pairs FROM (
  SELECT DISTINCT a.item_code, b.item_code FROM bi a JOIN bi b ON a.invoice_number = b.invoice_number
    AND a.customer_code IS NOT DISTINCT FROM b.customer_code AND a.item_code < b.item_code)"""))
def d3_cross_sell_total_pairs(e):
    return product.cross_sell_total_pairs(e.fact, WHOLE)


# --- D4 -------------------------------------------------------------------------------
_D4 = (_L, newest("item_description", "item_code", "l", "nd"), f"""rev AS (
  SELECT l.item_code, coalesce({msum('line_total')}, 0e0) AS revenue, coalesce(nd.newest_value, '') AS descr
  FROM l JOIN nd ON l.item_code IS NOT DISTINCT FROM nd.item_code GROUP BY l.item_code, nd.newest_value),
top AS (SELECT * FROM rev),
ci AS (SELECT DISTINCT customer_code, item_code FROM l WHERE item_code IN (SELECT item_code FROM top)),
sh AS (SELECT a.item_code AS product_a_code, b.item_code AS product_b_code, count(*) AS shared_customers
       FROM ci a JOIN ci b ON a.customer_code IS NOT DISTINCT FROM b.customer_code AND a.item_code < b.item_code
       GROUP BY a.item_code, b.item_code HAVING count(*) >= 5),
sc AS (
  SELECT s.product_a_code, ta.descr AS product_a_description, s.product_b_code, tb.descr AS product_b_description,
         s.shared_customers, ta.revenue AS product_a_revenue, tb.revenue AS product_b_revenue,
         s.shared_customers / (1 + abs(ta.revenue - tb.revenue) / greatest(ta.revenue, tb.revenue)) AS competition_score
  FROM sh s JOIN top ta ON s.product_a_code = ta.item_code JOIN top tb ON s.product_b_code = tb.item_code)""")


@register("d4_cannibalisation", _q(*_D4, select="""
SELECT * FROM sc ORDER BY competition_score DESC NULLS LAST, product_a_code, product_b_code LIMIT 20"""))
def d4_cannibalisation(e):
    return product.cannibalisation(e.fact, WHOLE).items


@register("d4_cannibalisation_summary", _q(*_D4, select="""
SELECT (SELECT count(*) FROM sc) AS total_pairs,
       (SELECT count(*) FROM (SELECT product_a_code FROM sc UNION SELECT product_b_code FROM sc)) AS products_at_risk"""))
def d4_cannibalisation_summary(e):
    return product.cannibalisation(e.fact, WHOLE).summary
