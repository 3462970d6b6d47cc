"""Registered queries: discount and returns analyses."""

from __future__ import annotations

from ..operators import discount
from ..operators.facts import LINE_COLUMNS
from .oracle_base import fine_mean, lines, margin_pct, msum, newest, with_base
from .registry import WHOLE, register


def _q(*ctes: str, select: str) -> str:
    return with_base("".join(", " + c for c in ctes) + "\n" + select)


_COST = "CASE WHEN coalesce(landed_cost_euro, 0e0) <> 0 THEN quantity * landed_cost_euro ELSE 0e0 END"

_G1 = (f"l AS (SELECT * FROM fact WHERE {lines(returns=True, samples=False)})",
       """dp AS (SELECT item_code, max(unit_price) AS derived_price FROM l
       WHERE (ie_base IS NULL OR ie_base <= 0) AND quantity > 0 AND unit_price > 0 GROUP BY item_code)""")


G1_COLUMNS = (*LINE_COLUMNS, "item_code", "quantity", "unit_price", "ie_base")


@register("g1_derived_catalogue_prices", _q(*_G1, select="SELECT * FROM dp"))
def g1_derived_catalogue_prices(e):
    lines_ = discount.base_filter(e.lines(*G1_COLUMNS), WHOLE, include_returns=True, include_samples=False)
    return discount.derived_catalogue_prices(lines_)


def g2_ctes(min_discount: float = 5, min_lines: int = 5):
    return (*_G1, """pr AS (SELECT l.*, CASE WHEN coalesce(ie_base, 0e0) <> 0 THEN ie_base ELSE dp.derived_price END AS price
       FROM l LEFT JOIN dp ON l.item_code = dp.item_code),
v AS (SELECT *, quantity * price AS potential, (quantity * price - line_total) / (quantity * price) * 100 AS disc
      FROM pr WHERE price IS NOT NULL AND price > 0 AND quantity <> 0),
v2 AS (SELECT * FROM v WHERE disc >= """ + repr(float(min_discount)) + """e0)""", newest("customer_name", "customer_code", "v2", "nm"), f"""g AS (
  SELECT v2.customer_code AS dimension_key, nm.newest_value AS dimension_name,
         coalesce({msum('line_total')}, 0e0) AS revenue_with_discount, coalesce({msum('potential')}, 0e0) AS revenue_without_discount,
         coalesce({msum(_COST)}, 0e0) AS cost, {fine_mean('disc')} AS avg_discount_percent, count(*) AS transaction_count
  FROM v2 JOIN nm ON v2.customer_code IS NOT DISTINCT FROM nm.customer_code
  GROUP BY v2.customer_code, nm.newest_value),
items AS (
  SELECT dimension_key, dimension_name, revenue_with_discount, revenue_without_discount, avg_discount_percent,
         revenue_with_discount - cost AS margin_with_discount, revenue_without_discount - cost AS margin_without_discount,
         CASE WHEN revenue_without_discount - cost > 0
              THEN ((revenue_without_discount - cost) - (revenue_with_discount - cost)) / (revenue_without_discount - cost) * 100
              ELSE 0e0 END AS margin_erosion_percent, transaction_count
  FROM g WHERE transaction_count >= {min_lines})""")


_G2 = g2_ctes()
_G2_LINES = (*G1_COLUMNS, "line_total", "landed_cost_euro")
G2_COLUMNS = {"customer": (*_G2_LINES, "invoice_number", "customer_code", "customer_name"),
              "product": (*_G2_LINES, "invoice_number", "item_description"), "month": _G2_LINES, "overall": _G2_LINES}


@register("g2_discount_effectiveness", _q(*_G2, select="""
SELECT * FROM items ORDER BY abs(margin_erosion_percent) DESC NULLS LAST, dimension_key LIMIT 20"""))
def g2_discount_effectiveness(e):
    return discount.discount_effectiveness(e.lines(*G2_COLUMNS["customer"]), WHOLE, dim="customer").items


@register("g2_discount_effectiveness_summary", _q(*_G2, select=f"""
SELECT coalesce({msum('revenue_with_discount')}, 0e0) AS total_revenue,
       coalesce({msum('revenue_without_discount')}, 0e0) - coalesce({msum('revenue_with_discount')}, 0e0) AS total_discount_given,
       coalesce({fine_mean('avg_discount_percent')}, 0e0) AS avg_discount_percent,
       coalesce({msum('margin_without_discount - margin_with_discount')}, 0e0) AS margin_impact FROM items"""))
def g2_discount_effectiveness_summary(e):
    return discount.discount_effectiveness(e.lines(*G2_COLUMNS["customer"]), WHOLE, dim="customer").summary


_G3 = (f"""fl AS (
  SELECT invoice_number, invoice_date, customer_code, customer_name, item_code,
         coalesce(item_description, '') AS product_description, quantity, unit_price, discount_percent, line_total,
         line_total - ({_COST}) AS margin, {margin_pct('line_total', _COST)} AS margin_percent
  FROM fact WHERE {lines(returns=False, samples=False)} AND discount_percent >= 20)""",)


@register("g3_high_discounts", _q(*_G3, select="""
SELECT * FROM fl ORDER BY discount_percent DESC NULLS LAST, invoice_date, invoice_number, item_code, line_total,
  customer_code LIMIT 20"""))
def g3_high_discounts(e):
    return discount.high_discounts(e.fact, WHOLE).items


@register("g3_high_discounts_summary", _q(*_G3, select=f"""
SELECT count(*) AS total_transactions, coalesce({msum('line_total')}, 0e0) AS total_revenue_at_risk,
       coalesce({fine_mean('discount_percent')}, 0e0) AS avg_discount, count(*) AS flagged_count FROM fl"""))
def g3_high_discounts_summary(e):
    return discount.high_discounts(e.fact, WHOLE).summary


_G4 = (f"""l AS (SELECT * FROM fact WHERE {lines(returns=True, samples=False)} AND (document_type = 'INV' OR is_return = 1))""",
       newest("item_description", "item_code", "l", "nd"), f"""g AS (
  SELECT l.item_code AS dimension_key, coalesce(nd.newest_value, '') AS dimension_name,
         coalesce({msum("CASE WHEN document_type = 'INV' THEN line_total END")}, 0e0) AS sales_revenue,
         abs(coalesce({msum('CASE WHEN is_return = 1 THEN line_total END')}, 0e0)) AS returns_value,
         count(CASE WHEN document_type = 'INV' THEN 1 END) AS sales_count,
         count(CASE WHEN is_return = 1 THEN 1 END) AS returns_count
  FROM l JOIN nd ON l.item_code IS NOT DISTINCT FROM nd.item_code GROUP BY l.item_code, nd.newest_value),
items AS (SELECT *, CASE WHEN sales_revenue > 0 THEN returns_value / sales_revenue * 100 ELSE 0e0 END AS return_rate_percent,
                 sales_revenue - returns_value AS net_revenue FROM g WHERE sales_count > 0)""")


G4_COLUMNS = (*LINE_COLUMNS, "invoice_number", "item_code", "item_description", "line_total")


@register("g4_returns", _q(*_G4, select="""
SELECT * FROM items ORDER BY return_rate_percent DESC NULLS LAST, dimension_key LIMIT 20"""))
def g4_returns(e):
    return discount.returns(e.lines(*G4_COLUMNS), WHOLE, dim="product").items


@register("g4_returns_summary", _q(*_G4, select=f"""
SELECT total_sales_revenue, total_returns_value,
       CASE WHEN total_sales_revenue > 0 THEN total_returns_value / total_sales_revenue * 100 ELSE 0e0 END AS return_rate_percent,
       total_sales_revenue - total_returns_value AS net_revenue
FROM (SELECT coalesce({msum('sales_revenue')}, 0e0) AS total_sales_revenue,
             coalesce({msum('returns_value')}, 0e0) AS total_returns_value FROM items)"""))
def g4_returns_summary(e):
    return discount.returns(e.lines(*G4_COLUMNS), WHOLE, dim="product").summary


_G5 = (f"""l AS (SELECT * FROM fact WHERE {lines(returns=True, samples=False)} AND (document_type = 'INV' OR (document_type = 'CRN' AND is_return = 0)))""",
       newest("customer_name", "customer_code", "l", "nm"), f"""g AS (
  SELECT l.customer_code AS dimension_key, nm.newest_value AS dimension_name,
         abs(coalesce({msum("CASE WHEN document_type = 'CRN' THEN line_total END")}, 0e0)) AS rebates_given,
         count(CASE WHEN document_type = 'CRN' THEN 1 END) AS rebate_count,
         count(CASE WHEN document_type = 'INV' THEN 1 END) AS sales_count,
         coalesce({msum("CASE WHEN document_type = 'INV' THEN line_total END")}, 0e0) AS total_sales,
         coalesce({msum(f"CASE WHEN document_type = 'INV' THEN {_COST} END")}, 0e0) AS sales_cost
  FROM l JOIN nm ON l.customer_code IS NOT DISTINCT FROM nm.customer_code GROUP BY l.customer_code, nm.newest_value),
items AS (SELECT dimension_key, dimension_name, rebates_given, rebate_count, total_sales,
                 CASE WHEN total_sales > 0 THEN rebates_given / total_sales * 100 ELSE 0e0 END AS rebate_percent,
                 total_sales - sales_cost AS margin_before_rebate, total_sales - sales_cost - rebates_given AS margin_after_rebate
          FROM g WHERE sales_count > 0 AND rebate_count > 0)""")


@register("g5_rebates", _q(*_G5, select="SELECT * FROM items ORDER BY rebates_given DESC NULLS LAST, dimension_key LIMIT 20"))
def g5_rebates(e):
    return discount.rebates(e.fact, WHOLE, dim="customer").items


@register("g5_rebates_summary", _q(*_G5, select=f"""
SELECT total_rebates, rebate_count, total_sales,
       CASE WHEN total_sales > 0 THEN total_rebates / total_sales * 100 ELSE 0e0 END AS rebate_as_percent_of_sales
FROM (SELECT coalesce({msum('rebates_given')}, 0e0) AS total_rebates, CAST(coalesce(sum(rebate_count), 0) AS BIGINT) AS rebate_count,
             coalesce({msum('total_sales')}, 0e0) AS total_sales FROM items)"""))
def g5_rebates_summary(e):
    return discount.rebates(e.fact, WHOLE, dim="customer").summary


@register("g6_credit_notes", _q(f"""l AS (SELECT * FROM fact WHERE {lines(returns=True, samples=False)})""", select=f"""
SELECT *, total_invoice_value - total_credit_note_value AS net_revenue,
       CASE WHEN total_invoice_value > 0 THEN total_credit_note_value / total_invoice_value * 100 ELSE 0e0 END
         AS credit_note_rate_percent
FROM (SELECT count(CASE WHEN document_type = 'INV' AND is_return = 0 THEN 1 END) AS total_invoices,
             coalesce({msum("CASE WHEN document_type = 'INV' AND is_return = 0 THEN line_total END")}, 0e0) AS total_invoice_value,
             count(CASE WHEN document_type = 'CRN' THEN 1 END) AS total_credit_notes,
             abs(coalesce({msum("CASE WHEN document_type = 'CRN' THEN line_total END")}, 0e0)) AS total_credit_note_value,
             count(CASE WHEN document_type = 'CRN' AND is_return = 1 THEN 1 END) AS returns_count,
             abs(coalesce({msum("CASE WHEN document_type = 'CRN' AND is_return = 1 THEN line_total END")}, 0e0)) AS returns_value,
             count(CASE WHEN document_type = 'CRN' AND is_return = 0 THEN 1 END) AS rebates_count,
             abs(coalesce({msum("CASE WHEN document_type = 'CRN' AND is_return = 0 THEN line_total END")}, 0e0)) AS rebates_value
      FROM l)"""))
def g6_credit_notes(e):
    return discount.credit_notes(e.lines(*LINE_COLUMNS, "line_total"), WHOLE)


# --- the same analyses along the calendar dimension ------------------------------------

_G4_MONTH = (f"""l AS (SELECT * FROM fact WHERE {lines(returns=True, samples=False)} AND (document_type = 'INV' OR is_return = 1))""", f"""g AS (
  SELECT substr(invoice_date, 1, 7) AS dimension_key, substr(invoice_date, 1, 7) AS dimension_name,
         coalesce({msum("CASE WHEN document_type = 'INV' THEN line_total END")}, 0e0) AS sales_revenue,
         abs(coalesce({msum('CASE WHEN is_return = 1 THEN line_total END')}, 0e0)) AS returns_value,
         count(CASE WHEN document_type = 'INV' THEN 1 END) AS sales_count,
         count(CASE WHEN is_return = 1 THEN 1 END) AS returns_count
  FROM l GROUP BY 1),
items AS (SELECT *, CASE WHEN sales_revenue > 0 THEN returns_value / sales_revenue * 100 ELSE 0e0 END AS return_rate_percent,
                 sales_revenue - returns_value AS net_revenue FROM g WHERE sales_count > 0)""")


@register("g4_returns_by_month", _q(*_G4_MONTH, select="""
SELECT * FROM items ORDER BY return_rate_percent DESC NULLS LAST, dimension_key LIMIT 20"""))
def g4_returns_by_month(e):
    return discount.returns(e.lines(*G4_COLUMNS), WHOLE, dim="month").items


_G5_OVERALL = (f"""l AS (SELECT * FROM fact WHERE {lines(returns=True, samples=False)} AND (document_type = 'INV' OR (document_type = 'CRN' AND is_return = 0)))""",)


@register("g5_rebates_overall", _q(*_G5_OVERALL, select=f"""
SELECT dimension_key, dimension_name, rebates_given, rebate_count, total_sales,
       CASE WHEN total_sales > 0 THEN rebates_given / total_sales * 100 ELSE 0e0 END AS rebate_percent,
       total_sales - sales_cost AS margin_before_rebate, total_sales - sales_cost - rebates_given AS margin_after_rebate
FROM (SELECT 'overall' AS dimension_key, 'All' AS dimension_name,
             abs(coalesce({msum("CASE WHEN document_type = 'CRN' THEN line_total END")}, 0e0)) AS rebates_given,
             count(CASE WHEN document_type = 'CRN' THEN 1 END) AS rebate_count,
             count(CASE WHEN document_type = 'INV' THEN 1 END) AS sales_count,
             coalesce({msum("CASE WHEN document_type = 'INV' THEN line_total END")}, 0e0) AS total_sales,
             coalesce({msum(f"CASE WHEN document_type = 'INV' THEN {_COST} END")}, 0e0) AS sales_cost FROM l)
WHERE sales_count > 0 AND rebate_count > 0"""))
def g5_rebates_overall(e):
    return discount.rebates(e.fact, WHOLE, dim="product").items  # product falls back to overall, as in the reference
