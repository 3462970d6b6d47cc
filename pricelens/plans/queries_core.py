"""Registered queries: base queries, margin, executive and pricing analyses."""

from __future__ import annotations

from ..operators import executive, facts, margin, pricing
from .oracle_base import (avg2, b2, b3, fine_mean, lines, m1, m2, margin as sql_margin, newest, r2, ratio0,
                          with_base, msum)
from .registry import WHOLE, register


def _q(*ctes: str, select: str) -> str:
    return with_base("".join(", " + c for c in ctes) + "\n" + select)


# --- B1-B3 base queries ---------------------------------------------------------------

@register("b1_sales_transactions", _q(select=f"""
SELECT invoice_number, invoice_date, customer_code, customer_name, item_code, quantity, unit_price, line_total,
       discount_percent, document_type, is_sample, is_return, landed_cost_euro, ie_base AS catalogue_price_base,
       ie_trade AS catalogue_price_trade, item_description AS product_description
FROM fact WHERE {lines()}"""))
def b1_sales_transactions(e):
    return facts.sales_transactions(e.fact, WHOLE)


@register("b1_high_discount_lines", _q(select=f"""
SELECT invoice_number, invoice_date, customer_code, customer_name, item_code, quantity, unit_price, line_total,
       discount_percent, document_type, is_sample, is_return, landed_cost_euro, ie_base AS catalogue_price_base,
       ie_trade AS catalogue_price_trade, item_description AS product_description
FROM fact WHERE {lines(returns=False, samples=False)} AND discount_percent >= 20 AND discount_percent <= 60
ORDER BY invoice_date DESC, invoice_number, item_code, line_total LIMIT 100"""))
def b1_high_discount_lines(e):
    return facts.sales_transactions(e.fact, WHOLE, include_returns=False, include_samples=False,
                                    min_discount=20, max_discount=60, limit=100)


@register("b2_customer_sales", _q(b2("b"), select="SELECT * FROM b"))
def b2_customer_sales(e):
    return facts.customer_sales(e.fact, WHOLE)


@register("b2_top_customers_by_cost", _q(b2("b", returns=False, samples=False), select="""
SELECT * FROM b WHERE transaction_count >= 5 ORDER BY total_cost DESC NULLS LAST, customer_code, customer_name LIMIT 25"""))
def b2_top_customers_by_cost(e):
    return facts.customer_sales(e.fact, WHOLE, include_returns=False, include_samples=False, min_transactions=5,
                                sort_by="cost", limit=25)


@register("b3_product_sales", _q(b3("b"), select="SELECT * FROM b"))
def b3_product_sales(e):
    return facts.product_sales(e.fact, WHOLE)


@register("b3_top_products_by_quantity", _q(b3("b", samples=False), select="""
SELECT * FROM b WHERE total_quantity >= 10 ORDER BY total_quantity DESC NULLS LAST, item_code LIMIT 25"""))
def b3_top_products_by_quantity(e):
    return facts.product_sales(e.fact, WHOLE, include_samples=False, min_quantity=10, sort_by="quantity", limit=25)


# --- M1, M2 margin --------------------------------------------------------------------

@register("m1_customer_profitability", _q(b2("b", returns=False, samples=False), m1("m", "b"), select="""
SELECT * FROM m ORDER BY gross_margin DESC NULLS LAST, customer_code, customer_name LIMIT 20"""))
def m1_customer_profitability(e):
    return margin.customer_profitability(e.fact, WHOLE, limit=20)


@register("m1_negative_margin_customers", _q(b2("b", returns=True, samples=False), m1("m", "b"), select="""
SELECT * FROM m WHERE margin_percent <= 0 ORDER BY gross_margin ASC NULLS LAST, customer_code, customer_name"""))
def m1_negative_margin_customers(e):
    return margin.customer_profitability(e.fact, WHOLE, include_returns=True, max_margin_percent=0,
                                         order="asc", limit=None)


@register("m2_product_performance", _q(b3("b"), m2("m", "b"), select="""
SELECT * FROM m ORDER BY revenue DESC NULLS LAST, item_code LIMIT 20"""))
def m2_product_performance(e):
    return margin.product_performance(e.fact, WHOLE, limit=20)


@register("m2_low_margin_products", _q(b3("b"), m2("m", "b"), select="""
SELECT * FROM m WHERE margin_percent >= -50 AND margin_percent <= 20 AND transaction_count >= 3
ORDER BY margin_percent ASC NULLS LAST, item_code"""))
def m2_low_margin_products(e):
    return margin.product_performance(e.fact, WHOLE, sort_by="margin_percent", order="asc", limit=None,
                                      min_margin_percent=-50, max_margin_percent=20, min_transactions=3)


# --- E1-E5 executive ------------------------------------------------------------------

E1_PARTS = (
    b2("top_b", returns=False, samples=False),
    b2("neg_b", returns=True, samples=False), m1("neg_m", "neg_b"),
    f"""inv AS (SELECT * FROM fact WHERE {lines(returns=False, samples=False, docs=('INV',))}),
line_kpi AS (
  SELECT coalesce({msum('line_total')}, 0e0) AS total_revenue, coalesce({msum('line_cost')}, 0e0) AS total_cost,
         count(*) AS transaction_count,
         count(DISTINCT customer_code) + max(CASE WHEN customer_code IS NULL THEN 1 ELSE 0 END) AS unique_customers,
         count(DISTINCT item_code) + max(CASE WHEN item_code IS NULL THEN 1 ELSE 0 END) AS unique_products,
         coalesce({msum('discount_percent')}, 0e0) AS discount_sum
  FROM inv),
top_kpi AS (SELECT coalesce({msum('total_revenue')}, 0e0) AS top_revenue FROM (
  SELECT total_revenue FROM top_b ORDER BY total_revenue DESC NULLS LAST, customer_code, customer_name LIMIT 10)),
neg_kpi AS (SELECT count(*) AS negative_margin_customers_count,
                   coalesce({msum('gross_margin')}, 0e0) AS negative_margin_amount FROM neg_m WHERE margin_percent <= 0),
ret_kpi AS (
  SELECT coalesce({msum('CASE WHEN is_return = 1 THEN abs(line_total) END')}, 0e0) AS return_amount,
         coalesce({msum('CASE WHEN is_return = 0 THEN line_total END')}, 0e0) AS sales_amount
  FROM fact WHERE {lines(returns=True, samples=False)})""",
    f"""
SELECT total_revenue, total_cost, {sql_margin('total_revenue', 'total_cost')} AS gross_margin,
       CASE WHEN total_revenue = 0 THEN 0e0 ELSE {r2('(total_revenue - total_cost) / total_revenue * 100')} END
         AS gross_margin_percent,
       transaction_count, unique_customers, unique_products,
       {avg2('total_revenue', 'transaction_count')} AS avg_order_value,
       {r2(ratio0('top_revenue', 'total_revenue') + ' * 100')} AS top_10_customer_concentration_percent,
       negative_margin_customers_count, negative_margin_amount,
       {r2(ratio0('return_amount', 'sales_amount') + ' * 100')} AS return_rate_percent,
       {avg2('discount_sum', 'transaction_count')} AS avg_discount_percent
FROM line_kpi, top_kpi, neg_kpi, ret_kpi""")
_E1 = _q(*E1_PARTS[:-1], select=E1_PARTS[-1])


@register("e1_executive_dashboard", _E1)
def e1_executive_dashboard(e):
    return executive.dashboard(e.fact, WHOLE)


@register("e2_negative_margin_customers", _q(b2("b", returns=True, samples=False), m1("m", "b"), select="""
SELECT customer_code, customer_name, gross_margin AS margin FROM m WHERE margin_percent <= 0
ORDER BY gross_margin ASC NULLS LAST, customer_code, customer_name LIMIT 10"""))
def e2_negative_margin_customers(e):
    return executive.negative_margin_customers(e.fact, WHOLE)


@register("e3_negative_margin_products", _q(b3("b"), m2("m", "b"), select="""
SELECT item_code, product_description, margin FROM m WHERE margin_percent <= 0 AND transaction_count >= 1
ORDER BY margin ASC NULLS LAST, item_code LIMIT 10"""))
def e3_negative_margin_products(e):
    return executive.negative_margin_products(e.fact, WHOLE)


@register("e4_high_discount_lines", _q(select=f"""
SELECT invoice_number, customer_code, item_code, discount_percent, margin FROM (
  SELECT invoice_number, customer_code, item_code, discount_percent,
         {sql_margin('line_total', 'coalesce(landed_cost_euro, 0e0) * quantity')} AS margin
  FROM fact WHERE {lines(returns=False, samples=False, docs=('INV',))} AND discount_percent > 20)
ORDER BY discount_percent DESC NULLS LAST, invoice_number, item_code, customer_code, margin LIMIT 10"""))
def e4_high_discount_lines(e):
    return executive.high_discount_lines(e.fact, WHOLE)


@register("e5_inactive_high_value", _q(b2("b", returns=False, samples=False), f"""last AS (
  SELECT customer_code, max(invoice_date) AS last_date FROM fact
  WHERE {lines(returns=False, samples=False, docs=('INV',))} GROUP BY customer_code)""", select="""
SELECT * FROM (
  SELECT b.customer_code, b.customer_name, date_diff('day', CAST(l.last_date AS DATE), DATE '2001-08-01') AS days_inactive,
         b.total_revenue AS lifetime_revenue
  FROM b JOIN last l ON b.customer_code = l.customer_code)
WHERE days_inactive > 90 AND lifetime_revenue > 10000
ORDER BY lifetime_revenue DESC NULLS LAST, customer_code LIMIT 10"""))
def e5_inactive_high_value(e):
    return executive.inactive_high_value(e.fact, WHOLE)


# --- R1-R4 pricing --------------------------------------------------------------------

_R1 = (b3("b", returns=True, samples=False, tier="ie_trade"),
       f"""top AS (SELECT * FROM b),
items AS (
  SELECT item_code, product_description, catalogue_price, avg_actual_price,
         avg_actual_price - catalogue_price AS price_variance,
         (avg_actual_price - catalogue_price) / catalogue_price * 100 AS variance_percent,
         transaction_count, total_revenue
  FROM (SELECT *, {r2(ratio0('total_revenue', 'total_quantity'))} AS avg_actual_price FROM top
        WHERE catalogue_price IS NOT NULL)
  WHERE abs((avg_actual_price - catalogue_price) / catalogue_price * 100) >= 5)""")


@register("r1_price_variance", _q(*_R1, select="SELECT * FROM items"))
def r1_price_variance(e):
    return pricing.price_variance(e.fact, WHOLE).items


@register("r1_price_variance_summary", _q(*_R1, select=f"""
SELECT (SELECT count(*) FROM top) AS total_products, count(*) AS products_with_variance,
       coalesce({fine_mean('abs(variance_percent)')}, 0e0) AS avg_variance_percent FROM items"""))
def r1_price_variance_summary(e):
    return pricing.price_variance(e.fact, WHOLE).summary


_R2 = (f"""l AS (SELECT * FROM fact WHERE {lines(returns=False, samples=False)})""",
       newest("item_description", "item_code", "l", "nd"),
       f"""g AS (
  SELECT l.item_code, coalesce(nd.newest_value, '') AS product_description, min(unit_price) AS min_price,
         max(unit_price) AS max_price,
         coalesce({msum('unit_price')}, 0e0) / count(*) AS avg_price, count(*) AS transaction_count
  FROM l JOIN nd ON l.item_code IS NOT DISTINCT FROM nd.item_code
  GROUP BY l.item_code, nd.newest_value),
g2 AS (SELECT *, max_price - min_price AS price_range,
              CASE WHEN avg_price > 0 THEN (max_price - min_price) / avg_price * 100 ELSE 0e0 END AS variation_percent
       FROM g)""")


_R2_COLUMNS = (*facts.LINE_COLUMNS, "invoice_number", "item_code", "item_description", "unit_price")


@register("r2_price_consistency", _q(*_R2, select="""
SELECT * FROM g2 WHERE variation_percent >= 5 AND transaction_count >= 3
ORDER BY variation_percent DESC NULLS LAST, item_code LIMIT 20"""))
def r2_price_consistency(e):
    return pricing.price_consistency(e.lines(*_R2_COLUMNS), WHOLE).items


@register("r2_price_consistency_summary", _q(*_R2, select=f"""
SELECT count(*) AS total_products,
       count(CASE WHEN variation_percent >= 5 AND transaction_count >= 3 THEN 1 END) AS products_with_inconsistency,
       coalesce({fine_mean('CASE WHEN variation_percent >= 5 AND transaction_count >= 3 THEN variation_percent END')},
                0e0) AS avg_price_variation
FROM g2"""))
def r2_price_consistency_summary(e):
    return pricing.price_consistency(e.lines(*_R2_COLUMNS), WHOLE).summary


_R3 = (f"""l AS (SELECT * FROM fact WHERE {lines(returns=False, samples=False)})""",
       newest("item_description", "item_code", "l", "nd"),
       f"""per_item AS (
  SELECT item_code, product_description, catalogue_price, avg_actual_price, compliant_count,
         n - compliant_count AS non_compliant_count, compliant_count / n * 100 AS compliance_percent
  FROM (
    SELECT l.item_code, coalesce(nd.newest_value, '') AS product_description, ie_trade AS catalogue_price,
           count(CASE WHEN abs(unit_price - ie_trade) / ie_trade <= 0.01e0 THEN 1 END) AS compliant_count,
           count(*) AS n, coalesce({msum('unit_price')}, 0e0) / count(*) AS avg_actual_price
    FROM l JOIN nd ON l.item_code IS NOT DISTINCT FROM nd.item_code
    WHERE ie_trade IS NOT NULL AND ie_trade <> 0
    GROUP BY l.item_code, nd.newest_value, ie_trade))""")


_R3_COLUMNS = (*_R2_COLUMNS, "ie_trade")


@register("r3_catalogue_compliance", _q(*_R3, select="""
SELECT * FROM per_item ORDER BY compliance_percent ASC NULLS LAST, item_code LIMIT 20"""))
def r3_catalogue_compliance(e):
    return pricing.catalogue_compliance(e.lines(*_R3_COLUMNS), WHOLE).items


@register("r3_catalogue_compliance_summary", _q(*_R3, select="""
SELECT t.total_transactions, c.compliant_transactions,
       CASE WHEN t.total_transactions > 0 THEN c.compliant_transactions / t.total_transactions * 100 ELSE 0e0 END
         AS compliance_rate
FROM (SELECT count(*) AS total_transactions FROM l) t,
     (SELECT CAST(coalesce(sum(compliant_count), 0) AS BIGINT) AS compliant_transactions FROM per_item) c"""))
def r3_catalogue_compliance_summary(e):
    return pricing.catalogue_compliance(e.lines(*_R3_COLUMNS), WHOLE).summary


_R4 = (b3("b", returns=False, samples=False),
       f"""items AS (
  SELECT item_code, product_description, catalogue_price_trade AS catalogue_price,
         {r2(ratio0('total_revenue', 'total_quantity'))} AS avg_actual_price, transaction_count,
         total_revenue AS revenue, total_revenue - total_cost AS margin
  FROM b
  WHERE catalogue_price_trade IS NOT NULL)""")


@register("r4_tier_performance", _q(*_R4, select="SELECT * FROM items"))
def r4_tier_performance(e):
    return pricing.tier_performance(e.fact, WHOLE).items


@register("r4_tier_performance_summary", _q(*_R4, select=f"""
SELECT total_revenue, total_margin,
       CASE WHEN total_revenue > 0 THEN total_margin / total_revenue * 100 ELSE 0e0 END AS avg_margin_percent
FROM (SELECT coalesce({msum('revenue')}, 0e0) AS total_revenue, coalesce({msum('margin')}, 0e0) AS total_margin
      FROM items)"""))
def r4_tier_performance_summary(e):
    return pricing.tier_performance(e.fact, WHOLE).summary
