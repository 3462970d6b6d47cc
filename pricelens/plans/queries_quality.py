"""Registered queries: data-quality analyses (Q1-Q3)."""

from __future__ import annotations

from ..operators import quality
from .oracle_base import b3, exact_mean, exact_std, lines, margin_pct, with_base
from .registry import WHOLE, register


def _q(*ctes: str, select: str) -> str:
    return with_base("".join(", " + c for c in ctes) + "\n" + select)


_Q1 = (f"""l AS (SELECT * FROM fact WHERE {lines(returns=False, samples=False)}),
st AS (SELECT item_code, count(*) AS n, {exact_mean('coalesce(unit_price, 0e0)')} AS pa,
              {exact_std('coalesce(unit_price, 0e0)')} AS ps,
              {exact_mean('coalesce(quantity, 0e0)')} AS qa, {exact_std('coalesce(quantity, 0e0)')} AS qs
       FROM l GROUP BY item_code HAVING count(*) >= 5),
j AS (SELECT l.*, st.pa, st.ps, st.qa, st.qs, coalesce(unit_price, 0e0) AS p, coalesce(quantity, 0e0) AS q,
             coalesce(line_total, 0e0) AS lt, coalesce(landed_cost_euro, 0e0) AS lc
      FROM l JOIN st ON l.item_code IS NOT DISTINCT FROM st.item_code),
j2 AS (SELECT *, q * lc AS cost, {margin_pct('lt', 'q * lc')} AS mp FROM j),
an AS (
  SELECT invoice_number, invoice_date, customer_code, customer_name, item_code, coalesce(item_description, '') AS product_description,
         'unusual_price' AS anomaly_type, pa AS expected_value, p AS actual_value, abs((p - pa) / pa * 100) AS deviation_percent,
         CASE WHEN abs((p - pa) / pa * 100) > 100 THEN 'high' WHEN abs((p - pa) / pa * 100) > 50 THEN 'medium' ELSE 'low' END AS severity
  FROM j2 WHERE ps > 0 AND abs(p - pa) / ps > 2.5
  UNION ALL
  SELECT invoice_number, invoice_date, customer_code, customer_name, item_code, coalesce(item_description, ''),
         'unusual_quantity', qa, q, abs((q - qa) / qa * 100),
         CASE WHEN abs((q - qa) / qa * 100) > 200 THEN 'high' WHEN abs((q - qa) / qa * 100) > 100 THEN 'medium' ELSE 'low' END
  FROM j2 WHERE qs > 0 AND abs(q - qa) / qs > 3
  UNION ALL
  SELECT invoice_number, invoice_date, customer_code, customer_name, item_code, coalesce(item_description, ''),
         'unusual_discount', NULL, discount_percent, discount_percent,
         CASE WHEN discount_percent > 60 THEN 'high' WHEN discount_percent > 50 THEN 'medium' ELSE 'low' END
  FROM j2 WHERE discount_percent > 40
  UNION ALL
  SELECT invoice_number, invoice_date, customer_code, customer_name, item_code, coalesce(item_description, ''),
         'negative_margin', NULL, lt - cost, abs(mp),
         CASE WHEN mp < -20 THEN 'high' WHEN mp < -10 THEN 'medium' ELSE 'low' END
  FROM j2 WHERE lc <> 0 AND lt - cost < 0)""",)


@register("q1_anomalies", _q(*_Q1, select="""
SELECT * FROM an ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC,
  deviation_percent DESC NULLS LAST, invoice_number, item_code, anomaly_type, invoice_date, customer_code, actual_value
LIMIT 50"""))
def q1_anomalies(e):
    return quality.anomalies(e.fact, WHOLE).items


@register("q1_anomalies_summary", _q(*_Q1, select="""
SELECT t.n AS total_transactions_analyzed, a.n AS anomalies_detected, a.h AS high_severity_count,
       CASE WHEN t.n > 0 THEN a.n / t.n * 100 ELSE 0e0 END AS anomaly_rate
FROM (SELECT count(*) AS n FROM l) t, (SELECT count(*) AS n, count(CASE WHEN severity = 'high' THEN 1 END) AS h FROM an) a"""))
def q1_anomalies_summary(e):
    return quality.anomalies(e.fact, WHOLE).summary


_ISSUE_ROW = ("(landed_cost_euro IS NULL OR ie_trade IS NULL OR coalesce(quantity, 0e0) <= 0 "
              "OR coalesce(unit_price, 0e0) <= 0)")
_Q2 = (f"""l AS (SELECT * FROM fact WHERE {lines()}),
w AS (SELECT count(*) AS total,
  count(CASE WHEN landed_cost_euro IS NULL THEN 1 END) AS missing_cost,
  count(CASE WHEN ie_trade IS NULL THEN 1 END) AS missing_catalogue_price,
  count(CASE WHEN item_description IS NULL OR trim(item_description) = '' THEN 1 END) AS missing_description,
  count(CASE WHEN coalesce(quantity, 0e0) <= 0 THEN 1 END) AS zero_quantity,
  count(CASE WHEN coalesce(unit_price, 0e0) <= 0 THEN 1 END) AS zero_price,
  count(CASE WHEN is_sample = 1 THEN 1 END) AS samples,
  count(CASE WHEN is_return = 1 THEN 1 END) AS returns,
  count(DISTINCT CASE WHEN {_ISSUE_ROW} THEN invoice_number END)
    + max(CASE WHEN {_ISSUE_ROW} AND invoice_number IS NULL THEN 1 ELSE 0 END) AS records
  FROM l)""",)


@register("q2_quality_summary", _q(*_Q2, select="""
SELECT issue_type, count, count / total * 100 AS percent_of_total, description, impact FROM (
  SELECT 'missing_cost' AS issue_type, missing_cost AS count, 'Transactions with missing landed cost data' AS description, 'high' AS impact, total FROM w
  UNION ALL SELECT 'missing_catalogue_price', missing_catalogue_price, 'Transactions with missing catalogue price', 'medium', total FROM w
  UNION ALL SELECT 'missing_description', missing_description, 'Transactions with missing product description', 'low', total FROM w
  UNION ALL SELECT 'zero_quantity', zero_quantity, 'Transactions with zero or negative quantity', 'high', total FROM w
  UNION ALL SELECT 'zero_price', zero_price, 'Transactions with zero or negative unit price', 'high', total FROM w
  UNION ALL SELECT 'samples', samples, 'Sample transactions (not revenue)', 'low', total FROM w
  UNION ALL SELECT 'returns', returns, 'Return transactions (negative revenue)', 'medium', total FROM w)
WHERE count > 0"""))
def q2_quality_summary(e):
    return quality.quality_summary(e.fact, WHOLE).items


@register("q2_quality_summary_totals", _q(*_Q2, select="""
SELECT total AS total_sales_records, records AS records_with_issues,
       CASE WHEN total > 0 THEN records / total * 100 ELSE 0e0 END AS issue_rate FROM w"""))
def q2_quality_summary_totals(e):
    return quality.quality_summary(e.fact, WHOLE).summary


_Q3 = (b3("b", returns=False, samples=False),)


@register("q3_orphaned_products", _q(*_Q3, select="""
SELECT item_code, product_description, true AS in_sales, landed_cost_euro IS NOT NULL AS has_cost,
       catalogue_price_trade IS NOT NULL AS has_catalogue,
       CASE WHEN landed_cost_euro IS NULL AND catalogue_price_trade IS NULL THEN 'missing_cost_and_catalogue'
            WHEN landed_cost_euro IS NULL THEN 'missing_cost' ELSE 'missing_catalogue' END AS issue_type,
       transaction_count, total_revenue
FROM b WHERE landed_cost_euro IS NULL OR catalogue_price_trade IS NULL
ORDER BY total_revenue DESC NULLS LAST, item_code LIMIT 50"""))
def q3_orphaned_products(e):
    return quality.orphaned_products(e.fact, WHOLE).items


@register("q3_orphaned_products_summary", _q(*_Q3, select="""
SELECT count(*) AS total_products,
       count(CASE WHEN landed_cost_euro IS NULL OR catalogue_price_trade IS NULL THEN 1 END) AS products_with_issues,
       count(CASE WHEN landed_cost_euro IS NULL THEN 1 END) AS missing_cost_count,
       count(CASE WHEN catalogue_price_trade IS NULL THEN 1 END) AS missing_catalogue_count FROM b"""))
def q3_orphaned_products_summary(e):
    return quality.orphaned_products(e.fact, WHOLE).summary
