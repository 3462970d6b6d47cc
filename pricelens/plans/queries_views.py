"""Registered queries: cleaning outputs (P*) and summary views (V1-V8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, views
from .oracle_base import msum, with_base
from .registry import register


def _q(*ctes: str, select: str) -> str:
    return with_base("".join(", " + c for c in ctes) + "\n" + select)


_SALES_COLS = ", ".join(cleaning.SALES_COLUMNS)


@register("p18_cleaned_sales", _q(select=f"SELECT {_SALES_COLS} FROM sales"))
def p18_cleaned_sales(e):
    return e.tables.sales.select(*cleaning.SALES_COLUMNS)


@register("p13_p14_deduplicated_dimensions", _q(select="""
SELECT 'catalogue' AS dim, item_code, ie_trade AS price FROM catalogue_prices
UNION ALL SELECT 'landed_cost', item_code, landed_cost_euro FROM landed_costs"""))
def p13_p14_deduplicated_dimensions(e):
    cat = e.tables.catalogue_prices.select(F.lit("catalogue").alias("dim"), "item_code", F.col("ie_trade").alias("price"))
    cost = e.tables.landed_costs.select(F.lit("landed_cost").alias("dim"), "item_code",
                                        F.col("landed_cost_euro").alias("price"))
    return cat.unionByName(cost)


@register("p15_pallet_sizes", _q(select="SELECT * FROM pallet_sizes"))
def p15_pallet_sizes(e):
    return e.tables.pallets


@register("p3_currency_distribution", _q(select="SELECT currency, count(*) AS records FROM sales_raw2 GROUP BY currency"))
def p3_currency_distribution(e):
    return cleaning.currency_distribution(e.raw.sales_raw)


@register("p3_non_eur_remaining", _q(select="""
SELECT CAST(count(CASE WHEN currency IS NULL OR currency <> 'EUR' THEN 1 END) AS BIGINT) AS non_eur_remaining FROM conv"""))
def p3_non_eur_remaining(e):
    return cleaning.non_eur_remaining(e.raw.sales_raw)


@register("p16_standard_names", _q(select="SELECT customer_code, standard_name FROM std_names"))
def p16_standard_names(e):
    return cleaning.standard_names(e.raw.sales_raw)


@register("p17_name_variations", _q(select="""
SELECT customer_code, standardized_name, occurrences, n_names FROM (
  SELECT customer_code, CAST(sum(cnt) AS BIGINT) AS occurrences, count(*) AS n_names,
         arg_min(customer_name, (-cnt, customer_name IS NULL, customer_name)) AS standardized_name
  FROM name_counts GROUP BY customer_code) WHERE n_names > 1"""))
def p17_name_variations(e):
    v = cleaning.name_variations(e.raw.sales_raw)
    return v.select("customer_code", "standardized_name", "occurrences", F.size("original_names").cast("long").alias("n_names"))


@register("p17_names_by_count", _q(select="""
SELECT customer_code, customer_name AS original_name, cnt AS occurrences,
       rank() OVER (PARTITION BY customer_code ORDER BY cnt DESC) AS place, standard_name AS standardized_name
FROM name_counts JOIN std_names USING (customer_code)
QUALIFY count(*) OVER (PARTITION BY customer_code) > 1"""))
def p17_names_by_count(e):
    return cleaning.names_by_count(e.raw.sales_raw)


_P19 = """
SELECT 'sales_records' AS metric, count(*) AS value FROM ruled
UNION ALL SELECT 'invoices', count(CASE WHEN document_type = 'INV' THEN 1 END) FROM ruled
UNION ALL SELECT 'credit_notes', count(CASE WHEN document_type = 'CRN' THEN 1 END) FROM ruled
UNION ALL SELECT 'currency_converted', count(CASE WHEN raw_currency = 'GBP' THEN 1 END) FROM ruled
UNION ALL SELECT 'price_rebates_marked', count(CASE WHEN document_type = 'CRN' AND unit_price < 0 THEN 1 END) FROM ruled
UNION ALL SELECT 'negative_qty_on_inv_fixed', count(data_quality_issue) FROM ruled
UNION ALL SELECT 'returns_marked', count(CASE WHEN is_return = 1 THEN 1 END) FROM ruled
UNION ALL SELECT 'quantity_rebates_marked', count(CASE WHEN document_type = 'CRN' AND raw_quantity > 0 THEN 1 END) FROM ruled
UNION ALL SELECT 'fractional_qty_marked', count(CASE WHEN unit_type = 'meter' THEN 1 END) FROM ruled
UNION ALL SELECT 'near_zero_samples_marked', count(CASE WHEN document_type = 'INV' AND unit_price > 0 AND unit_price < 0.1e0 THEN 1 END) FROM ruled
UNION ALL SELECT 'zero_price_samples_marked', count(CASE WHEN unit_price = 0 AND raw_quantity > 0
       AND NOT (document_type = 'INV' AND unit_price > 0 AND unit_price < 0.1e0) THEN 1 END) FROM ruled
UNION ALL SELECT 'catalogue_duplicates_removed', count(*) - (count(DISTINCT item_code) + count(*) - count(item_code)) FROM catalogue_raw
UNION ALL SELECT 'catalogue_records', count(DISTINCT item_code) + count(*) - count(item_code) FROM catalogue_raw
UNION ALL SELECT 'cost_duplicates_removed', count(*) - (count(DISTINCT item_code) + count(*) - count(item_code)) FROM landed_costs_raw2
UNION ALL SELECT 'landed_cost_records', count(DISTINCT item_code) + count(*) - count(item_code) FROM landed_costs_raw2
UNION ALL SELECT 'empty_pallets_removed', count(CASE WHEN item_code IS NULL OR item_code = '' THEN 1 END) FROM pallet_raw
UNION ALL SELECT 'pallet_records', count(CASE WHEN item_code IS NOT NULL AND item_code <> '' THEN 1 END) FROM pallet_raw
UNION ALL SELECT 'customer_records', count(*) FROM customer_product_keys
UNION ALL SELECT 'customer_names_standardized', count(*) FROM std_names
UNION ALL SELECT 'customer_name_variations', count(*) FROM (SELECT customer_code FROM name_counts GROUP BY customer_code HAVING count(*) > 1)"""


@register("p19_cleaning_metrics", _q(select=f"SELECT metric, CAST(value AS BIGINT) AS value FROM ({_P19})"))
def p19_cleaning_metrics(e):
    r = e.raw
    return cleaning.cleaning_metrics(r.sales_raw, r.catalogue_prices, r.landed_costs, r.pallet_sizes,
                                     r.customer_product_keys)


@register("v1_product_pricing_raw", _q(select="""
SELECT c.item_code, c.ie_trade, c.ie_high, c.ie_mid, c.ie_low, c.ie_base, c.ie_edm, c.ie_anew,
       l.landed_cost_euro, l.plus_5_percent, p.pallet_quantity, p.carton_quantity, p.single_quantity
FROM catalogue_raw c LEFT JOIN landed_costs_raw2 l ON c.item_code = l.item_code LEFT JOIN pallet_raw p ON c.item_code = p.item_code"""))
def v1_product_pricing_raw(e):
    r = e.raw
    return views.product_pricing_raw(r.catalogue_prices.drop("load_key"), r.landed_costs, r.pallet_sizes)


@register("v2_sales_by_customer_raw", _q(select=f"""
SELECT customer_code, customer_name, count(DISTINCT invoice_number) AS total_invoices, count(*) AS total_line_items,
       {msum('quantity')} AS total_quantity, {msum('line_total')} AS total_revenue,
       {msum('line_total')} / count(line_total) AS avg_line_value,
       min(invoice_date) AS first_purchase_date, max(invoice_date) AS last_purchase_date
FROM sales_raw2 WHERE customer_code IS NOT NULL GROUP BY customer_code, customer_name"""))
def v2_sales_by_customer_raw(e):
    return views.sales_by_customer_raw(e.raw.sales_raw)


@register("v3_sales_by_product_raw", _q(select=f"""
SELECT a.*, c.ie_trade, c.ie_base, l.landed_cost_euro FROM (
  SELECT item_code, max(item_description) AS item_description, count(DISTINCT customer_code) AS unique_customers,
         count(DISTINCT invoice_number) AS total_invoices, {msum('quantity')} AS total_quantity,
         {msum('line_total')} AS total_revenue, {msum('unit_price')} / count(unit_price) AS avg_unit_price
  FROM sales_raw2 GROUP BY item_code) a
LEFT JOIN catalogue_prices c ON a.item_code = c.item_code LEFT JOIN landed_costs l ON a.item_code = l.item_code"""))
def v3_sales_by_product_raw(e):
    return views.sales_by_product_raw(e.raw.sales_raw, e.tables.catalogue_prices, e.tables.landed_costs)


@register("v4_monthly_sales_raw", _q(select=f"""
SELECT strftime(CAST(invoice_date AS DATE), '%Y-%m') AS month, count(DISTINCT customer_code) AS unique_customers,
       count(DISTINCT invoice_number) AS total_invoices, count(*) AS total_line_items,
       {msum('quantity')} AS total_quantity, {msum('line_total')} AS total_revenue,
       {msum('line_total')} / count(line_total) AS avg_line_value
FROM sales_raw2 WHERE invoice_date IS NOT NULL AND invoice_date <> '' GROUP BY 1"""))
def v4_monthly_sales_raw(e):
    return views.monthly_sales_raw(e.raw.sales_raw)


@register("v5_product_pricing", _q(select="""
SELECT c.item_code, c.ie_trade AS catalogue_price, l.landed_cost_euro AS landed_cost, c.ie_trade - l.landed_cost_euro AS margin,
       CASE WHEN l.landed_cost_euro > 0 THEN (c.ie_trade - l.landed_cost_euro) / l.landed_cost_euro * 100 END AS margin_percentage
FROM catalogue_prices c LEFT JOIN landed_costs l ON c.item_code = l.item_code"""))
def v5_product_pricing(e):
    return views.product_pricing(e.tables)


@register("v6_sales_by_customer", _q(select=f"""
SELECT customer_code, customer_name, count(*) AS transaction_count, {msum('quantity')} AS total_quantity,
       {msum('line_total')} AS total_revenue FROM sales GROUP BY customer_code, customer_name"""))
def v6_sales_by_customer(e):
    return views.sales_by_customer(e.tables)


@register("v7_sales_by_product", _q(select=f"""
SELECT item_code, max(item_description) AS item_description, count(*) AS transaction_count, {msum('quantity')} AS total_quantity,
       {msum('line_total')} AS total_revenue, {msum('unit_price')} / count(unit_price) AS avg_unit_price
FROM sales GROUP BY item_code"""))
def v7_sales_by_product(e):
    return views.sales_by_product(e.tables)


@register("v8_monthly_sales", _q(select=f"""
SELECT strftime(CAST(invoice_date AS DATE), '%Y-%m') AS month, count(*) AS transaction_count,
       {msum('quantity')} AS total_quantity, {msum('line_total')} AS total_revenue FROM sales GROUP BY 1"""))
def v8_monthly_sales(e):
    return views.monthly_sales(e.tables)
