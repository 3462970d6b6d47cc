"""Registered queries of the scalar and list helpers that no analysis uses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import facts
from ..operators.margin import customer_profitability
from .oracle_base import r2, with_base
from .queries_core import b2, lines, m1
from .registry import WHOLE, register


def _q(*ctes: str, select: str) -> str:
    return with_base("".join(", " + c for c in ctes) + "\n" + select)


# The sums are whole micro-units, so DECIMAL(18,6) holds them exactly and halves round up.
@register("c6_rounded_revenue", _q(b2("b"), select="""
SELECT customer_code, customer_name, CAST(round(CAST(coalesce(total_revenue, 0e0) AS DECIMAL(18,6)), 2) AS DOUBLE) AS revenue,
       CAST(round(CAST(coalesce(total_quantity, 0e0) AS DECIMAL(18,6)), 0) AS DOUBLE) AS quantity FROM b"""))
def c6_rounded_revenue(e):
    return facts.customer_sales(e.fact, WHOLE).select(
        "customer_code", "customer_name", M.round_to("total_revenue").alias("revenue"),
        M.round_to("total_quantity", 0).alias("quantity"))


@register("c7_negative_margins", _q(b2("b", returns=True, samples=False), m1("m", "b"), select="""
SELECT * FROM m WHERE gross_margin < 0"""))
def c7_negative_margins(e):
    return M.filter_negative_margins(customer_profitability(e.fact, WHOLE, include_returns=True, limit=None))


@register("c8_high_discounts", _q(select=f"""
SELECT invoice_number, invoice_date, customer_code, item_code, line_total, discount_percent
FROM fact WHERE {lines()} AND discount_percent > 20"""))
def c8_high_discounts(e):
    return M.filter_high_discounts(facts.sales_transactions(e.fact, WHOLE), 20).select(
        "invoice_number", "invoice_date", "customer_code", "item_code", "line_total", "discount_percent")


@register("c9_customers_by_transactions", _q(b2("b"), select="SELECT * FROM b WHERE transaction_count >= 40"))
def c9_customers_by_transactions(e):
    return M.filter_min_transactions(facts.customer_sales(e.fact, WHOLE), 40)


@register("c12_page_of_customers", _q(b2("b"), select="""
SELECT * FROM b ORDER BY total_revenue DESC NULLS LAST, customer_code, customer_name LIMIT 50 OFFSET 100"""))
def c12_page_of_customers(e):
    ordered = M.sort_by(facts.customer_sales(e.fact, WHOLE), "total_revenue", "desc", "customer_code", "customer_name")
    return M.paginate(ordered, 3, 50)


@register("c13_line_discounts", _q(select=f"""
SELECT invoice_number, item_code, quantity, line_total,
       CASE WHEN ie_base IS NULL OR ie_base <= 0 OR quantity = 0 THEN 0e0
            ELSE {r2('(quantity * ie_base - line_total) / (quantity * ie_base) * 100')} END AS discount
FROM fact WHERE {lines()}"""))
def c13_line_discounts(e):
    return facts.base_filter(e.fact, WHOLE).select(
        "invoice_number", "item_code", "quantity", "line_total",
        M.discount_percent("quantity", "line_total", "ie_base").alias("discount"))
