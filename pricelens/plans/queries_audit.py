"""Registered queries: ad-hoc lookups and audit checks."""

from __future__ import annotations

from ..operators import audit
from .oracle_base import msum, with_base, r2, ratio0
from .registry import register

ITEM, CUSTOMER = "IEZ1", "C1"


def _q(*ctes: str, select: str) -> str:
    return with_base("".join(", " + c for c in ctes) + "\n" + select)


def _cents(x: str) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(18,6)), 2) AS DOUBLE)"


_ORPH = "o AS (SELECT * FROM sales s WHERE item_code IS NOT NULL AND NOT EXISTS (SELECT 1 FROM catalogue_prices c WHERE c.item_code = s.item_code))"

SPECS = [
    ("a1_catalogue_lookup", lambda e: audit.catalogue_lookup(e.tables, ITEM),
     _q(select=f"SELECT * FROM catalogue_prices WHERE item_code = '{ITEM}' ORDER BY item_code LIMIT 1")),
    ("a2_customer_summary", lambda e: audit.customer_summary(e.tables, CUSTOMER),
     _q(select=f"SELECT customer_code, customer_name, count(*) AS transaction_count, {msum('quantity')} AS total_quantity, "
               f"{msum('line_total')} AS total_revenue FROM sales WHERE customer_code = '{CUSTOMER}' GROUP BY 1, 2")),
    ("a3_top_selling_products", lambda e: audit.top_selling_products(e.with_sales("item_code", "customer_code", "quantity", "line_total")),
     _q(select=f"SELECT item_code, {msum('quantity')} AS total_quantity, {msum('line_total')} AS total_revenue, "
               "count(DISTINCT customer_code) AS unique_customers FROM sales GROUP BY item_code ORDER BY total_quantity DESC NULLS LAST, item_code LIMIT 10")),
    ("a4_sales_with_pricing", lambda e: audit.sales_with_pricing(e.tables, ITEM),
     _q(select=f"""SELECT s.*, c.ie_trade, c.ie_high, l.landed_cost_euro FROM sales s LEFT JOIN catalogue_prices c ON s.item_code = c.item_code
       LEFT JOIN landed_costs l ON s.item_code = l.item_code WHERE s.item_code = '{ITEM}'
       ORDER BY s.invoice_date DESC, s.invoice_number, s.line_total, s.customer_code LIMIT 100""")),
    ("a5_customers_for_product", lambda e: audit.customers_for_product(e.tables, ITEM),
     _q(select=f"SELECT customer_code, customer_name, count(*) AS purchase_count, {msum('quantity')} AS total_quantity, "
               f"{msum('line_total')} AS total_spent FROM sales WHERE item_code = '{ITEM}' GROUP BY customer_code, customer_name")),
    ("a6_stats_by_month", lambda e: audit.stats_by_month(e.with_sales("invoice_date", "quantity", "line_total")),
     _q(select=f"SELECT substr(invoice_date, 1, 7) AS month, count(*) AS transaction_count, {msum('quantity')} AS total_quantity, "
               f"{msum('line_total')} AS total_revenue, {msum('line_total')} / count(line_total) AS avg_line_value FROM sales "
               "WHERE invoice_date IS NOT NULL AND invoice_date <> '' GROUP BY 1")),
    ("a7_missing_value_profile", lambda e: audit.missing_values(e.raw),
     _q(select=" UNION ALL ".join(
         f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS null_count FROM {source}"
         for t, source, columns in (
             ("sales", "sales_raw2", ["invoice_number", "invoice_date", "customer_code", "customer_name", "item_code",
                                      "quantity", "unit_price", "line_total"]),
             ("catalogue_prices", "catalogue_raw", ["item_code", "ie_trade", "ie_high"]),
             ("landed_costs", "landed_costs_raw2", ["item_code", "landed_cost_euro"])) for c in columns))),
    ("a8_duplicate_keys", lambda e: audit.duplicate_items(e.raw),
     _q(select=" UNION ALL ".join(
         f"SELECT '{t}' AS table_name, item_code, count(*) AS occurrences FROM {source} GROUP BY item_code HAVING count(*) > 1"
         for t, source in (("catalogue_prices", "catalogue_raw"), ("landed_costs", "landed_costs_raw2"), ("pallet_sizes", "pallet_raw"))))),
    ("a9_orphan_item_sample", lambda e: audit.orphan_item_sample(e.with_sales("item_code")),
     _q(_ORPH, select="SELECT DISTINCT item_code FROM o ORDER BY item_code LIMIT 10")),
    ("a9_orphan_item_count", lambda e: audit.orphan_item_count(e.with_sales("item_code")),
     _q(_ORPH, select="SELECT count(DISTINCT item_code) AS orphaned_item_codes FROM o")),
    ("a10_orphan_customer_codes", lambda e: audit.orphan_customer_codes(e.with_sales("customer_code")),
     _q(select="SELECT DISTINCT customer_code FROM sales s WHERE customer_code IS NOT NULL AND NOT EXISTS "
               "(SELECT 1 FROM customer_product_keys k WHERE k.customer_code = s.customer_code)")),
    ("a11_date_validation", lambda e: audit.date_validation(e.with_sales("invoice_date")),
     _q(select="""SELECT count(CASE WHEN invoice_date IS NULL THEN 1 END) AS null_dates,
       count(CASE WHEN invoice_date IS NOT NULL AND NOT invoice_date LIKE '____-__-__' THEN 1 END) AS malformed_dates,
       count(CASE WHEN TRY_CAST(substr(invoice_date, 1, 4) AS INTEGER) < 2000 OR TRY_CAST(substr(invoice_date, 1, 4) AS INTEGER) > 2025
             THEN 1 END) AS out_of_range_dates, count(CASE WHEN wrong THEN 1 END) AS invalid_dates,
       min(CASE WHEN wrong THEN invoice_date END) AS min_date, max(CASE WHEN wrong THEN invoice_date END) AS max_date
       FROM (SELECT *, invoice_date IS NULL OR NOT invoice_date LIKE '____-__-__'
             OR TRY_CAST(substr(invoice_date, 1, 4) AS INTEGER) < 2000 OR TRY_CAST(substr(invoice_date, 1, 4) AS INTEGER) > 2025 AS wrong
             FROM sales)""")),
    ("a12_non_positive_values", lambda e: audit.non_positive_values(e.raw),
     _q(select="""SELECT 'non_positive_quantity' AS metric, count(CASE WHEN quantity <= 0 THEN 1 END) AS value FROM sales_raw2
       UNION ALL SELECT 'non_positive_price', count(CASE WHEN unit_price <= 0 THEN 1 END) FROM sales_raw2
       UNION ALL SELECT 'non_positive_ie_trade', count(CASE WHEN ie_trade <= 0 THEN 1 END) FROM catalogue_raw
       UNION ALL SELECT 'non_positive_ie_high', count(CASE WHEN ie_high <= 0 THEN 1 END) FROM catalogue_raw
       UNION ALL SELECT 'non_positive_ie_mid', count(CASE WHEN ie_mid <= 0 THEN 1 END) FROM catalogue_raw
       UNION ALL SELECT 'non_positive_cost', count(CASE WHEN landed_cost_euro <= 0 THEN 1 END) FROM landed_costs""")),
    ("a13_line_total_consistency", lambda e: audit.line_total_inconsistencies(e.raw),
     _q(select="SELECT count(CASE WHEN abs(line_total - quantity * unit_price) > 0.01 THEN 1 END) AS inconsistent_lines FROM sales_raw2")),
    ("a14_name_variations_per_code", lambda e: audit.name_variations_per_code(e.raw.sales_raw),
     _q(select="SELECT customer_code, count(DISTINCT customer_name) AS name_count FROM sales_raw2 WHERE customer_code IS NOT NULL GROUP BY customer_code "
               "HAVING count(DISTINCT customer_name) > 1")),
    ("a15_whitespace_keys", lambda e: audit.whitespace_keys(e.raw.sales_raw),
     _q(select="SELECT count(CASE WHEN item_code <> trim(item_code) THEN 1 END) AS item_codes_with_spaces, "
               "count(CASE WHEN customer_code <> trim(customer_code) THEN 1 END) AS customer_codes_with_spaces FROM sales_raw2")),
    ("a17_table_row_counts", lambda e: audit.table_row_counts(e.tables),
     _q(select="""SELECT 'sales' AS table_name, count(*) AS row_count FROM sales
       UNION ALL SELECT 'catalogue_prices', count(*) FROM catalogue_prices UNION ALL SELECT 'landed_costs', count(*) FROM landed_costs
       UNION ALL SELECT 'customers', count(*) FROM customer_product_keys UNION ALL SELECT 'pallets', count(*) FROM pallet_sizes""")),
    ("a18_orphan_summary", lambda e: audit.orphan_summary(e.with_sales("item_code", "quantity", "line_total")),
     _q(_ORPH, select=f"SELECT count(DISTINCT item_code) AS orphaned_items, count(*) AS orphaned_lines, "
                      f"{msum('quantity')} AS total_quantity, {_cents(msum('line_total'))} AS total_revenue FROM o")),
    ("a19_top_orphan_items", lambda e: audit.orphan_items(e.tables),
     _q(_ORPH, select=f"""SELECT item_code, count(*) AS line_count,
       count(DISTINCT customer_code) AS customer_count, count(DISTINCT invoice_number) AS invoice_count,
       {msum('quantity')} AS total_quantity, {_cents(msum('line_total'))} AS total_revenue, {_cents(msum('unit_price') + ' / count(unit_price)')} AS avg_unit_price, min(invoice_date) AS first_sale,
       max(invoice_date) AS last_sale FROM o GROUP BY item_code ORDER BY line_count DESC, item_code LIMIT 20""")),
    ("a20_orphan_negative_revenue", lambda e: audit.orphan_negative_revenue(
        e.with_sales("item_code", "quantity", "unit_price", "line_total")),
     _q(_ORPH, select=f"""SELECT item_code, count(*) AS line_count, {msum('quantity')} AS total_quantity,
       {_cents(msum('line_total'))} AS total_revenue, {_cents(msum('unit_price') + ' / count(unit_price)')} AS avg_unit_price FROM o
       WHERE line_total < 0 GROUP BY item_code ORDER BY total_revenue, item_code LIMIT 20""")),
    ("a21_orphans_by_customer", lambda e: audit.orphans_by_customer(e.tables),
     _q(_ORPH, select=f"""SELECT customer_code, customer_name, count(*) AS orphaned_lines, count(DISTINCT item_code) AS orphaned_items,
       {_cents(msum('line_total'))} AS orphaned_revenue FROM o GROUP BY customer_code, customer_name
       ORDER BY orphaned_lines DESC, customer_code NULLS LAST, customer_name NULLS LAST LIMIT 20""")),
    ("a22_orphans_by_month", lambda e: audit.orphans_by_month(e.with_sales("item_code", "invoice_date", "quantity", "line_total")),
     _q(_ORPH, select=f"SELECT substr(invoice_date, 1, 7) AS month, count(DISTINCT item_code) AS orphaned_items, count(*) AS orphaned_lines, "
                      f"{msum('quantity')} AS total_quantity, {_cents(msum('line_total'))} AS orphaned_revenue "
                      "FROM o WHERE invoice_date IS NOT NULL AND invoice_date <> '' GROUP BY 1")),
    ("a23_catalogue_never_sold", lambda e: audit.catalogue_never_sold(e.with_sales("item_code")),
     _q(select="SELECT item_code, ie_trade, ie_high, ie_mid, ie_low FROM catalogue_prices c "
               "WHERE NOT EXISTS (SELECT 1 FROM sales s WHERE s.item_code = c.item_code)")),
    ("a24_invoice_orphan_breakdown", lambda e: audit.invoice_orphan_breakdown(e.with_sales("invoice_number", "item_code", "line_total")),
     _q(select=f"""SELECT *, {r2(ratio0('orphaned_revenue', 'invoice_revenue') + ' * 100')} AS orphaned_revenue_percent FROM (
       SELECT invoice_number, count(*) AS total_lines, count(CASE WHEN c.item_code IS NULL THEN 1 END) AS orphaned_lines,
              coalesce({msum('CASE WHEN c.item_code IS NULL THEN line_total END')}, 0e0) AS orphaned_revenue,
              coalesce({msum('line_total')}, 0e0) AS invoice_revenue
       FROM sales s LEFT JOIN (SELECT item_code FROM catalogue_prices) c ON s.item_code = c.item_code GROUP BY invoice_number)""")),
    ("a25_invoice_lines_excluding_samples", lambda e: audit.invoice_lines_excluding_samples(e.tables),
     _q(select="SELECT * FROM sales WHERE document_type = 'INV' AND is_sample = 0")),
    ("a26_net_revenue_per_customer", lambda e: audit.net_revenue_per_customer(e.tables),
     _q(select=f"SELECT customer_code, customer_name, coalesce({msum('CASE WHEN is_return = 0 THEN line_total ELSE 0e0 END')}, 0e0) AS net_revenue "
               "FROM sales GROUP BY customer_code, customer_name")),
    ("a27_metre_sales", lambda e: audit.metre_sales(
        e.with_sales("invoice_number", "item_code", "quantity", "unit_type")),
     _q(select="SELECT invoice_number, item_code, quantity, unit_type FROM sales WHERE unit_type = 'meter'")),
    ("a28_quality_issue_lines", lambda e: audit.quality_issue_lines(
        e.with_sales("invoice_number", "item_code", "quantity", "data_quality_issue")),
     _q(select="SELECT invoice_number, item_code, quantity, data_quality_issue FROM sales WHERE data_quality_issue IS NOT NULL")),
    ("a29_pure_sales_by_customer_name", lambda e: audit.pure_sales_by_customer_name(e.tables),
     _q(select=f"SELECT customer_name, {msum('quantity * unit_price')} AS pure_sales_revenue FROM sales WHERE document_type = 'INV' "
               "AND is_return = 0 AND is_rebate = 0 AND is_sample = 0 GROUP BY customer_name")),
    ("a30_high_markup_products", lambda e: audit.high_markup_products(e.tables),
     _q(select="""SELECT * FROM (SELECT c.item_code, c.ie_trade, l.landed_cost_euro,
       (c.ie_trade - l.landed_cost_euro) / l.landed_cost_euro * 100 AS markup_percent
       FROM catalogue_prices c JOIN landed_costs l ON c.item_code = l.item_code) WHERE markup_percent > 20""")),
    ("a31_top_customers_by_revenue", lambda e: audit.top_customers_by_revenue(e.tables),
     _q(select=f"SELECT customer_code, customer_name, count(*) AS transaction_count, {msum('quantity')} AS total_quantity, "
               f"{msum('line_total')} AS total_revenue FROM sales WHERE customer_code IS NOT NULL "
               "GROUP BY customer_code, customer_name ORDER BY total_revenue DESC NULLS LAST, customer_code LIMIT 10")),
    ("a32_month_over_month", lambda e: audit.month_over_month(e.with_sales("invoice_date", "quantity", "line_total")),
     _q(select=f"""SELECT month, total_quantity, total_revenue, lag(total_revenue) OVER (ORDER BY month) AS previous_revenue FROM (
       SELECT substr(invoice_date, 1, 7) AS month, {msum('quantity')} AS total_quantity, {msum('line_total')} AS total_revenue FROM sales
       WHERE invoice_date IS NOT NULL GROUP BY 1)""")),
]

_LINE = "invoice_number, invoice_date, customer_code, item_code, quantity, unit_price, line_total"
SPECS += [
    ("a16a_non_positive_quantity_sample", lambda e: audit.row_samples(e.tables, ITEM, CUSTOMER)["a"],
     _q(select=f"SELECT {_LINE} FROM sales WHERE quantity <= 0 ORDER BY {_LINE} LIMIT 5")),
    ("a16b_non_positive_price_sample", lambda e: audit.row_samples(e.tables, ITEM, CUSTOMER)["b"],
     _q(select=f"SELECT {_LINE} FROM sales WHERE unit_price <= 0 ORDER BY {_LINE} LIMIT 5")),
    ("a16c_catalogue_rows_of_code", lambda e: audit.row_samples(e.tables, ITEM, CUSTOMER)["c"],
     _q(select=f"SELECT * FROM catalogue_prices WHERE item_code = '{ITEM}'")),
    ("a16e_name_counts_of_customer", lambda e: audit.row_samples(e.tables, ITEM, CUSTOMER)["e"],
     _q(select=f"SELECT customer_name, count(*) AS occurrences FROM sales WHERE customer_code = '{CUSTOMER}' GROUP BY customer_name")),
]

SPECS += [
    ("a16a_raw_non_positive_quantity_sample", lambda e: audit.raw_row_samples(e.raw, ITEM, CUSTOMER)["a"],
     _q(select=f"SELECT {_LINE} FROM sales_raw2 WHERE quantity <= 0 ORDER BY {_LINE} LIMIT 5")),
    ("a16b_raw_non_positive_price_sample", lambda e: audit.raw_row_samples(e.raw, ITEM, CUSTOMER)["b"],
     _q(select=f"SELECT {_LINE} FROM sales_raw2 WHERE unit_price <= 0 ORDER BY {_LINE} LIMIT 5")),
    ("a16c_raw_catalogue_rows_of_code", lambda e: audit.raw_row_samples(e.raw, ITEM, CUSTOMER)["c"],
     _q(select=f"SELECT * FROM catalogue_raw WHERE item_code = '{ITEM}'")),
    ("a16d_raw_blank_pallet_codes", lambda e: audit.raw_row_samples(e.raw, ITEM, CUSTOMER)["d"],
     _q(select="SELECT * FROM pallet_raw WHERE item_code IS NULL OR trim(item_code) = '' ORDER BY ALL LIMIT 5")),
    ("a16e_raw_name_counts_of_customer", lambda e: audit.raw_row_samples(e.raw, ITEM, CUSTOMER)["e"],
     _q(select=f"SELECT customer_name, count(*) AS occurrences FROM sales_raw2 WHERE customer_code = '{CUSTOMER}' GROUP BY customer_name")),
]

for _name, _fn, _sql in SPECS:
    register(_name, _sql)(_fn)
