"""Registered queries: functions specified but not implemented by the reference."""

from __future__ import annotations

from ..operators import extended as X
from ..operators.facts import LINE_COLUMNS
from .oracle_base import b2, b3, exact_covar, exact_mean, exact_std, fine_mean, lines, margin as sql_margin, margin_pct, msum, newest, r2, ratio0, with_base
from .registry import WHOLE, register
from .queries_trends import LAST_YEAR


def _q(*ctes: str, select: str) -> str:
    return with_base("".join(", " + c for c in ctes) + "\n" + select)


_L = f"l AS (SELECT * FROM fact WHERE {lines(returns=False, samples=False)})"
_RATIO_PRICE = r2(ratio0("revenue", "quantity_sold"))
_TIERS = ["ie_trade", "ie_high", "ie_mid", "ie_low", "ie_base", "ie_edm", "ie_anew"]
_MATCH = "CASE " + " ".join(
    f"WHEN {t} IS NOT NULL AND {t} > 0 AND abs(unit_price - {t}) / {t} <= 0.01 THEN '{t}'" for t in _TIERS) + " ELSE 'custom' END"
_TIER_PRICE = "CASE " + " ".join(f"WHEN tier_matched = '{t}' THEN {t}" for t in _TIERS) + " END"


@register("x1_margin_by_customer_product", _q(_L, select=f"""
SELECT *, {sql_margin('revenue', 'cost')} AS margin, {margin_pct('revenue', 'cost')} AS margin_percent FROM (
  SELECT customer_code, customer_name, item_code, coalesce({msum('line_total')}, 0e0) AS revenue,
         coalesce({msum('line_cost')}, 0e0) AS cost, count(*) AS transaction_count
  FROM l GROUP BY customer_code, customer_name, item_code) WHERE {sql_margin('revenue', 'cost')} < 0"""))
def x1_margin_by_customer_product(e):
    return X.margin_by_dimension(e.fact, WHOLE, "customer_product", only_negative=True)


@register("x1_margin_by_month", _q(_L, select=f"""
SELECT *, {sql_margin('revenue', 'cost')} AS margin, {margin_pct('revenue', 'cost')} AS margin_percent FROM (
  SELECT substr(invoice_date, 1, 7) AS month, coalesce({msum('line_total')}, 0e0) AS revenue,
         coalesce({msum('line_cost')}, 0e0) AS cost, count(*) AS transaction_count FROM l GROUP BY 1)"""))
def x1_margin_by_month(e):
    return X.margin_by_dimension(e.fact, WHOLE, "month")


@register("x2_customer_product_matrix", _q(_L, newest("item_description", "customer_code, customer_name, item_code", "l", "nd"), select=f"""
SELECT *, {sql_margin('revenue', 'cost')} AS margin, {margin_pct('revenue', 'cost')} AS margin_percent,
       {_RATIO_PRICE} AS avg_unit_price FROM (
  SELECT l.customer_code, l.customer_name, l.item_code, coalesce(nd.newest_value, '') AS product_description,
         coalesce({msum('quantity')}, 0e0) AS quantity_sold, coalesce({msum('line_total')}, 0e0) AS revenue,
         coalesce({msum('line_cost')}, 0e0) AS cost, max(landed_cost_euro) AS landed_cost,
         coalesce({fine_mean(r2('discount_percent'))}, 0e0) AS avg_discount_percent
  FROM l JOIN nd ON l.customer_code IS NOT DISTINCT FROM nd.customer_code AND l.customer_name IS NOT DISTINCT FROM nd.customer_name
    AND l.item_code IS NOT DISTINCT FROM nd.item_code
  GROUP BY l.customer_code, l.customer_name, l.item_code, nd.newest_value)"""))
def x2_customer_product_matrix(e):
    return X.customer_product_matrix(e.fact, WHOLE)


@register("x3_price_tier_usage", _q(_L, select=f"""
SELECT item_code, tier_matched, count(*) AS transaction_count, coalesce({msum('line_total')}, 0e0) AS total_revenue,
       coalesce({msum('unit_price')}, 0e0) / count(*) AS avg_actual_price, max({_TIER_PRICE}) AS catalogue_price
FROM (SELECT *, {_MATCH} AS tier_matched FROM l) GROUP BY item_code, tier_matched"""))
def x3_price_tier_usage(e):
    return X.price_tier_usage(e.fact, WHOLE)


@register("x4_price_position", _q(_L, newest("item_description", "item_code", "l", "nd"), f"""pc AS (
  SELECT item_code, customer_code, coalesce({msum('unit_price')}, 0e0) / count(*) AS cust_avg FROM l GROUP BY item_code, customer_code),
pi AS (SELECT item_code, count(*) AS customer_count, {fine_mean('cust_avg')} AS avg_price, min(cust_avg) AS min_price,
              max(cust_avg) AS max_price FROM pc GROUP BY item_code)""", select="""
SELECT pi.*, coalesce(nd.newest_value, '') AS product_description,
       (SELECT count(*) FROM pc WHERE pc.item_code = pi.item_code AND pc.cust_avg < pi.avg_price) AS customers_below_avg,
       (SELECT count(*) FROM pc WHERE pc.item_code = pi.item_code AND pc.cust_avg > pi.avg_price) AS customers_above_avg,
       max_price - min_price AS price_spread
FROM pi JOIN nd ON pi.item_code = nd.item_code"""))
def x4_price_position(e):
    return X.price_position(e.fact, WHOLE)


@register("x7_herfindahl_index", _q(b2("b", returns=False, samples=False), select=f"""
SELECT count(*) AS total_customers, coalesce({msum('total_revenue')}, 0e0) AS total_revenue,
       CAST(SUM(CAST((total_revenue / tr) * (total_revenue / tr) AS DECIMAL(38,18))) AS DOUBLE) AS concentration_index
FROM b, (SELECT coalesce({msum('total_revenue')}, 0e0) AS tr FROM b)"""))
def x7_herfindahl_index(e):
    return X.herfindahl(e.fact, WHOLE)


@register("x12_sample_impact", _q(f"""s AS (SELECT * FROM fact WHERE {lines(returns=False, samples=True)} AND customer_code IS NOT NULL)""", select=f"""
SELECT customer_code, customer_name, samples_given_count, samples_given_cost, total_paid_purchases_revenue,
       total_paid_purchases_revenue - paid_cost AS total_paid_purchases_margin,
       CASE WHEN total_paid_purchases_revenue <> 0 THEN samples_given_cost / total_paid_purchases_revenue END AS sample_to_revenue_ratio,
       CASE WHEN samples_given_cost <> 0 THEN (total_paid_purchases_revenue - paid_cost - samples_given_cost) / samples_given_cost END
         AS estimated_roi
FROM (SELECT customer_code, customer_name, count(CASE WHEN is_sample = 1 THEN 1 END) AS samples_given_count,
             coalesce({msum('CASE WHEN is_sample = 1 THEN line_cost END')}, 0e0) AS samples_given_cost,
             coalesce({msum('CASE WHEN is_sample = 0 THEN line_total END')}, 0e0) AS total_paid_purchases_revenue,
             coalesce({msum('CASE WHEN is_sample = 0 THEN line_cost END')}, 0e0) AS paid_cost
      FROM s GROUP BY customer_code, customer_name) WHERE samples_given_count > 0"""))
def x12_sample_impact(e):
    return X.sample_impact(e.fact, WHOLE)


_ORDERS = (_L, f"""o AS (
  SELECT l.invoice_number, l.customer_code, l.customer_name, l.item_code, coalesce({msum('quantity')}, 0e0) AS order_quantity,
         count(*) AS lines, p.pallet_quantity
  FROM l JOIN pallet_sizes p ON l.item_code = p.item_code
  WHERE l.document_type = 'INV' AND p.pallet_quantity > 0
  GROUP BY l.invoice_number, l.customer_code, l.customer_name, l.item_code, p.pallet_quantity)""")


@register("x13_pallet_optimisation", _q(*_ORDERS, newest("item_description", "item_code", "l", "nd"), select=f"""
SELECT g.*, coalesce(nd.newest_value, '') AS product_description, total_orders - orders_matching_pallet AS orders_not_optimized,
       orders_matching_pallet / total_orders * 100 AS optimization_rate_percent
FROM (SELECT item_code, pallet_quantity, coalesce({msum('order_quantity')}, 0e0) / count(*) AS avg_order_quantity,
             count(CASE WHEN order_quantity > 0 AND order_quantity - pallet_quantity * floor(order_quantity / pallet_quantity) = 0
                   THEN 1 END) AS orders_matching_pallet, count(*) AS total_orders
      FROM o GROUP BY item_code, pallet_quantity) g LEFT JOIN nd ON g.item_code = nd.item_code"""))
def x13_pallet_optimisation(e):
    return X.pallet_optimisation(e.fact, WHOLE, e.tables.pallets)


def _x14(key: str, name: str, source: str) -> str:
    return f"""
SELECT {key} AS dimension_key, {name} AS dimension_name,
       coalesce({msum('order_quantity')}, 0e0) / count(*) AS avg_order_size,
       sum(lines) / count(DISTINCT invoice_number) AS avg_line_items_per_order,
       CAST(SUM(CAST(order_quantity / pallet_quantity AS DECIMAL(28,10))) AS DOUBLE) AS total_pallets_equivalent,
       count(CASE WHEN order_quantity < pallet_quantity THEN 1 END) AS small_orders_count,
       count(CASE WHEN order_quantity > 0 AND order_quantity - pallet_quantity * floor(order_quantity / pallet_quantity) = 0
             THEN 1 END) AS optimal_orders_count,
       count(CASE WHEN order_quantity > 0 AND order_quantity - pallet_quantity * floor(order_quantity / pallet_quantity) = 0
             THEN 1 END) / count(*) * 100 AS order_efficiency_score
FROM {source} GROUP BY {key}"""


@register("x14_order_efficiency_by_product", _q(*_ORDERS, newest("item_description", "item_code", "l", "nd"), select=_x14(
    "o.item_code", "coalesce(max(nd.newest_value), '')", "o JOIN nd ON o.item_code = nd.item_code")))
def x14_order_efficiency_by_product(e):
    return X.order_efficiency(e.fact, WHOLE, e.tables.pallets, "product")


@register("x14_order_efficiency", _q(*_ORDERS, select=_x14("customer_code", "max(customer_name)", "o")))
def x14_order_efficiency(e):
    return X.order_efficiency(e.fact, WHOLE, e.tables.pallets)


@register("x15_price_tier_performance", _q(_L, select=f"""
SELECT price_tier, transaction_count, revenue, {sql_margin('revenue', 'cost')} AS margin,
       {margin_pct('revenue', 'cost')} AS margin_percent, unique_customers, unique_products FROM (
  SELECT {_MATCH} AS price_tier, count(*) AS transaction_count, coalesce({msum('line_total')}, 0e0) AS revenue,
         coalesce({msum('line_cost')}, 0e0) AS cost,
         count(DISTINCT customer_code) + max(CASE WHEN customer_code IS NULL THEN 1 ELSE 0 END) AS unique_customers,
         count(DISTINCT item_code) + max(CASE WHEN item_code IS NULL THEN 1 ELSE 0 END) AS unique_products
  FROM l GROUP BY 1)"""))
def x15_price_tier_performance(e):
    return X.tier_performance_by_tier(e.fact, WHOLE)


@register("x16_orphan_status", _q("""u AS (
  SELECT item_code, 1 AS c, 0 AS s, 0 AS l, 0 AS p FROM catalogue_prices WHERE item_code IS NOT NULL
  UNION ALL SELECT item_code, 0, 1, 0, 0 FROM sales WHERE item_code IS NOT NULL
  UNION ALL SELECT item_code, 0, 0, 1, 0 FROM landed_costs WHERE item_code IS NOT NULL
  UNION ALL SELECT item_code, 0, 0, 0, 1 FROM pallet_sizes WHERE item_code IS NOT NULL),
g AS (SELECT item_code, max(c) = 1 AS in_catalogue, max(s) = 1 AS in_sales, max(l) = 1 AS in_landed_costs,
             max(p) = 1 AS has_pallet_data FROM u GROUP BY item_code)""", newest("item_description", "item_code", "sales", "nd"), select="""
SELECT * FROM (SELECT g.*, coalesce(nd.newest_value, '') AS product_description, CASE WHEN NOT in_sales THEN 'never_sold' WHEN NOT in_catalogue THEN 'missing_catalogue'
                              WHEN NOT in_landed_costs THEN 'missing_cost' WHEN NOT has_pallet_data THEN 'incomplete' END AS issue_type
               FROM g LEFT JOIN nd ON g.item_code = nd.item_code) WHERE issue_type IS NOT NULL"""))
def x16_orphan_status(e):
    return X.orphan_status(e.tables)


@register("x17_margin_contribution", _q(b2("b", returns=False, samples=False), f"""m AS (
  SELECT customer_code, customer_name, total_revenue, total_revenue - total_cost AS margin_contribution FROM b),
tot AS (SELECT coalesce({msum('margin_contribution')}, 0e0) AS tm, coalesce({msum('total_revenue')}, 0e0) AS tr FROM m),
top AS (SELECT *, row_number() OVER (ORDER BY margin_contribution DESC NULLS LAST, customer_code, customer_name) AS rk
        FROM m)""", select="""
SELECT customer_code, customer_name, margin_contribution, margin_contribution / tm * 100 AS margin_contribution_percent,
       total_revenue / tr * 100 AS revenue_contribution_percent, margin_contribution / total_revenue AS margin_to_revenue_ratio,
       CAST(SUM(CAST(margin_contribution AS DECIMAL(38,6))) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
         / tm * 100 AS cumulative_margin_percent
FROM top, tot"""))
def x17_margin_contribution(e):
    return X.margin_contribution(e.fact, WHOLE)


@register("x18_breakeven", _q(b3("b", returns=False, samples=False), select=f"""
SELECT item_code, product_description, landed_cost_euro AS landed_cost, cur AS current_avg_price,
       {margin_pct('total_revenue', 'total_cost')} AS current_margin_percent, landed_cost_euro AS breakeven_price,
       landed_cost_euro / (1 - 20 / 100e0) AS target_margin_price,
       greatest(landed_cost_euro / (1 - 20 / 100e0) - cur, 0e0) AS price_increase_needed,
       CASE WHEN cur > 0 THEN greatest(landed_cost_euro / (1 - 20 / 100e0) - cur, 0e0) / cur * 100 END AS price_increase_percent
FROM (SELECT *, {r2(ratio0('total_revenue', 'total_quantity'))} AS cur FROM b WHERE landed_cost_euro IS NOT NULL AND landed_cost_euro > 0)"""))
def x18_breakeven(e):
    return X.breakeven(e.fact, WHOLE)


@register("x19_waterfall", _q(f"""w AS (SELECT * FROM fact WHERE {lines(returns=True, samples=False)}),
a AS (SELECT
  coalesce({msum("CASE WHEN document_type = 'INV' AND is_return = 0 THEN (CASE WHEN ie_base IS NOT NULL AND ie_base > 0 THEN quantity * ie_base ELSE line_total END) END")}, 0e0) AS gross_revenue,
  coalesce({msum("CASE WHEN document_type = 'INV' AND is_return = 0 THEN line_total END")}, 0e0) AS invoiced,
  abs(coalesce({msum("CASE WHEN document_type = 'CRN' AND is_return = 1 THEN line_total END")}, 0e0)) AS less_returns,
  abs(coalesce({msum("CASE WHEN document_type = 'CRN' AND is_return = 0 THEN line_total END")}, 0e0)) AS less_rebates,
  coalesce({msum("CASE WHEN document_type = 'INV' AND is_return = 0 THEN line_cost END")}, 0e0) AS less_cost_of_goods
  FROM w)""", select="""
SELECT gross_revenue, less_returns, less_rebates, gross_revenue - less_returns - less_rebates AS net_revenue,
       gross_revenue - invoiced AS less_discounts,
       (gross_revenue - less_returns - less_rebates) - (gross_revenue - invoiced) AS revenue_after_discounts, less_cost_of_goods,
       (gross_revenue - less_returns - less_rebates) - (gross_revenue - invoiced) - less_cost_of_goods AS gross_margin,
       CASE WHEN (gross_revenue - less_returns - less_rebates) - (gross_revenue - invoiced) <> 0
            THEN ((gross_revenue - less_returns - less_rebates) - (gross_revenue - invoiced) - less_cost_of_goods)
                 / ((gross_revenue - less_returns - less_rebates) - (gross_revenue - invoiced)) * 100 ELSE 0e0 END AS gross_margin_percent
FROM a"""))
def x19_waterfall(e):
    return X.waterfall(e.fact, WHOLE)


@register("x20_price_elasticity", _q(f"""p AS (SELECT * FROM fact WHERE {lines(returns=False, samples=False)} AND quantity > 0 AND unit_price > 0)""",
                                     newest("item_description", "item_code", "p", "nd"), select=f"""
SELECT * , CASE WHEN estimated_elasticity IS NULL THEN NULL WHEN abs(estimated_elasticity) > 1.05 THEN 'elastic'
                WHEN abs(estimated_elasticity) < 0.95 THEN 'inelastic' ELSE 'unit_elastic' END AS elasticity_interpretation
FROM (SELECT p.item_code, coalesce(nd.newest_value, '') AS product_description, {exact_mean('unit_price')} AS avg_price,
             {exact_std('unit_price')} AS price_std_dev, {exact_mean('quantity')} AS avg_volume, {exact_std('quantity')} AS volume_std_dev,
             {exact_covar('unit_price', 'quantity')} / NULLIF({exact_std('unit_price')} * {exact_std('quantity')}, 0) AS correlation,
             {exact_covar('ln(quantity)', 'ln(unit_price)')} / NULLIF({exact_covar('ln(unit_price)', 'ln(unit_price)')}, 0) AS estimated_elasticity
      FROM p JOIN nd ON p.item_code = nd.item_code GROUP BY p.item_code, nd.newest_value HAVING count(*) >= 3)"""))
def x20_price_elasticity(e):
    return X.price_elasticity(e.fact, WHOLE)


@register("x21_contribution_by_buying_group", _q(_L, select=f"""
SELECT segment, revenue, variable_costs, revenue - variable_costs AS contribution_margin,
       {margin_pct('revenue', 'variable_costs')} AS contribution_margin_percent,
       CASE WHEN revenue <> 0 THEN (revenue - variable_costs) / revenue ELSE 0e0 END AS contribution_margin_ratio
FROM (SELECT coalesce(k.buying_group, 'Unassigned') AS segment, coalesce({msum('line_total')}, 0e0) AS revenue,
             coalesce({msum('line_cost')}, 0e0) AS variable_costs
      FROM l LEFT JOIN (SELECT customer_code, min(buying_group) AS buying_group FROM customer_product_keys GROUP BY 1) k
        ON l.customer_code = k.customer_code GROUP BY 1)"""))
def x21_contribution_by_buying_group(e):
    return X.contribution_by_segment(e.fact, WHOLE, e.tables.customers, "customer_segment")


@register("x23_wider_quality_report", _q(select="""
SELECT 'total_sales_records' AS metric, count(*) AS value FROM sales
UNION ALL SELECT 'records_with_dq_issues', count(data_quality_issue) FROM sales
UNION ALL SELECT 'invoices_with_negative_qty_corrected',
  count(CASE WHEN data_quality_issue = 'Negative quantity on invoice - converted to positive' THEN 1 END) FROM sales
UNION ALL SELECT 'samples_and_promos', count(CASE WHEN is_sample = 1 THEN 1 END) FROM sales
UNION ALL SELECT 'returns', count(CASE WHEN is_return = 1 THEN 1 END) FROM sales
UNION ALL SELECT 'rebates', count(CASE WHEN is_rebate = 1 THEN 1 END) FROM sales
UNION ALL SELECT 'products_missing_cost', count(DISTINCT item_code) FROM sales s WHERE NOT EXISTS
  (SELECT 1 FROM landed_costs l WHERE l.item_code = s.item_code AND l.landed_cost_euro IS NOT NULL)
UNION ALL SELECT 'products_missing_catalogue', count(DISTINCT item_code) FROM sales s WHERE NOT EXISTS
  (SELECT 1 FROM catalogue_prices c WHERE c.item_code = s.item_code)
UNION ALL SELECT 'customer_name_variations', count(*) FROM (SELECT customer_code FROM sales_raw2 WHERE customer_code IS NOT NULL
  GROUP BY customer_code HAVING count(DISTINCT customer_name) > 1)"""))
def x23_wider_quality_report(e):
    return X.wider_quality_report(e.tables, e.raw.sales_raw)


from .queries_customer_product import _D1, _U1  # noqa: E402
from .queries_discount import _G4  # noqa: E402


@register("x5_lifetime_value_annual", _q(*_U1, select="SELECT *, total_revenue / customer_age_days * 365 AS estimated_annual_value FROM items"))
def x5_lifetime_value_annual(e):
    return X.lifetime_value_annual(e.fact, WHOLE)


@register("x26_high_return_products", _q(*_G4, select="""
SELECT * FROM items ORDER BY return_rate_percent DESC NULLS LAST, dimension_key LIMIT 10"""))
def x26_high_return_products(e):
    return X.problem_report_extra(e.fact, WHOLE).summary


@register("x26_slow_moving_stock", _q(*_D1, select="SELECT * FROM sc ORDER BY transaction_count ASC NULLS LAST, item_code LIMIT 10"))
def x26_slow_moving_stock(e):
    return X.problem_report_extra(e.fact, WHOLE).items


@register("x8_product_ranks", _q(b3("b"), """m AS (SELECT * FROM b)""", select=f"""
SELECT *, rank() OVER (ORDER BY revenue DESC NULLS LAST) AS revenue_rank, rank() OVER (ORDER BY margin DESC NULLS LAST) AS margin_rank
FROM (SELECT item_code, product_description, total_quantity AS quantity_sold, total_revenue AS revenue, total_cost AS cost,
             {sql_margin('total_revenue', 'total_cost')} AS margin, {margin_pct('total_revenue', 'total_cost')} AS margin_percent,
             unique_customers, transaction_count, {r2(ratio0('total_quantity', 'CAST(transaction_count AS DOUBLE)'))} AS avg_order_quantity
      FROM b)"""))
def x8_product_ranks(e):
    return X.product_ranks(e.fact, WHOLE)


from .queries_customer_product import _D3  # noqa: E402

_X10_COLUMNS = (*LINE_COLUMNS, "invoice_number", "customer_code", "item_code", "item_description")


@register("x10_cross_sell_lift", _q(*_D3, """sup AS (
  SELECT item_code, count(*) AS na, count(DISTINCT customer_code) + max(CASE WHEN customer_code IS NULL THEN 1 ELSE 0 END) AS ca
  FROM bi GROUP BY item_code),
nb AS (SELECT count(*) AS baskets FROM (SELECT DISTINCT invoice_number, customer_code FROM bi))""", select="""
SELECT sc.product_a_code, product_a_description, sc.product_b_code, product_b_description, co_occurrence_count,
       customers_buying_both, confidence, customers_buying_both / a.ca * 100 AS customer_confidence,
       co_occurrence_count * nb.baskets / (a.na * b.na) AS lift
FROM sc JOIN sup a ON sc.product_a_code = a.item_code JOIN sup b ON sc.product_b_code = b.item_code, nb"""))
def x10_cross_sell_lift(e):
    return X.cross_sell_lift(e.lines(*_X10_COLUMNS), WHOLE, min_co_occurrence=2)


@register("x6_churn_decline", _q(f"""c AS (SELECT * FROM fact WHERE document_type IN ('INV', 'CRN') AND is_sample = 0 AND is_return = 0
  AND invoice_date BETWEEN '2000-08-02' AND '2001-08-01' AND customer_code IS NOT NULL),
g AS (SELECT customer_code, customer_name,
             coalesce({msum("CASE WHEN invoice_date < '2001-01-31' THEN line_total END")}, 0e0) AS previous_period_revenue,
             coalesce({msum("CASE WHEN invoice_date >= '2001-01-31' THEN line_total END")}, 0e0) AS current_period_revenue,
             coalesce({msum('line_total')}, 0e0) AS lifetime_revenue, max(invoice_date) AS last_purchase_date
      FROM c GROUP BY customer_code, customer_name),
g2 AS (SELECT *, date_diff('day', CAST(last_purchase_date AS DATE), DATE '2001-08-01') AS days_since_last_purchase,
              CASE WHEN previous_period_revenue > 0 THEN (previous_period_revenue - current_period_revenue) / previous_period_revenue * 100
                   ELSE 0e0 END AS revenue_decline_percent FROM g),
g3 AS (SELECT *, CASE WHEN days_since_last_purchase > 90 AND lifetime_revenue > 10000 THEN 'high'
                      WHEN days_since_last_purchase > 90 OR revenue_decline_percent >= 30 THEN 'medium' ELSE 'low' END AS risk_level FROM g2)""",
                                 select="SELECT * FROM g3 WHERE risk_level <> 'low'"))
def x6_churn_decline(e):
    return X.churn_decline(e.fact, LAST_YEAR)


@register("x6_churn_decline_history", _q(f"""c AS (SELECT * FROM fact WHERE document_type IN ('INV', 'CRN') AND is_sample = 0 AND is_return = 0
  AND invoice_date BETWEEN '1995-01-01' AND '2001-08-01' AND customer_code IS NOT NULL),
g AS (SELECT customer_code, customer_name,
             coalesce({msum("CASE WHEN invoice_date >= '2000-08-02' AND invoice_date < '2001-01-31' THEN line_total END")}, 0e0) AS previous_period_revenue,
             coalesce({msum("CASE WHEN invoice_date >= '2001-01-31' THEN line_total END")}, 0e0) AS current_period_revenue,
             coalesce({msum('line_total')}, 0e0) AS lifetime_revenue, max(invoice_date) AS last_purchase_date
      FROM c GROUP BY customer_code, customer_name),
g2 AS (SELECT *, date_diff('day', CAST(last_purchase_date AS DATE), DATE '2001-08-01') AS days_since_last_purchase,
              CASE WHEN previous_period_revenue > 0 THEN (previous_period_revenue - current_period_revenue) / previous_period_revenue * 100
                   ELSE 0e0 END AS revenue_decline_percent FROM g),
g3 AS (SELECT *, CASE WHEN days_since_last_purchase > 90 AND lifetime_revenue > 10000 THEN 'high'
                      WHEN days_since_last_purchase > 90 OR revenue_decline_percent >= 30 THEN 'medium' ELSE 'low' END AS risk_level FROM g2)""",
                                 select="SELECT * FROM g3 WHERE risk_level <> 'low'"))
def x6_churn_decline_history(e):
    return X.churn_decline(e.fact, LAST_YEAR, history=WHOLE)


from .queries_discount import g2_ctes  # noqa: E402


@register("x25_discount_impact", _q(*g2_ctes(0, 1), select="""
SELECT dimension_key, dimension_name, revenue_with_discount AS total_revenue,
       revenue_without_discount - revenue_with_discount AS total_discount_given, revenue_without_discount AS revenue_before_discount,
       avg_discount_percent, margin_without_discount, margin_with_discount, margin_without_discount - margin_with_discount AS margin_impact,
       transaction_count FROM items"""))
def x25_discount_impact(e):
    return X.discount_impact(e.fact, WHOLE)


@register("x11_discount_volume_lift", _q(f"""d AS (SELECT * FROM fact WHERE {lines(returns=False, samples=False)}
  AND ie_base IS NOT NULL AND ie_base > 0 AND quantity <> 0)""", newest("customer_name", "customer_code", "d", "nm"), select=f"""
SELECT *, CASE WHEN full_price_lines > 0 AND discounted_lines > 0 AND volume_without_discount / full_price_lines > 0
               THEN (volume_with_discount / discounted_lines - volume_without_discount / full_price_lines)
                    / (volume_without_discount / full_price_lines) * 100 END AS volume_lift_percent
FROM (SELECT d.customer_code AS dimension_key, nm.newest_value AS dimension_name,
             coalesce({msum('CASE WHEN discount_percent > 0 THEN quantity END')}, 0e0) AS volume_with_discount,
             coalesce({msum('CASE WHEN NOT discount_percent > 0 THEN quantity END')}, 0e0) AS volume_without_discount,
             count(CASE WHEN discount_percent > 0 THEN 1 END) AS discounted_lines,
             count(CASE WHEN NOT discount_percent > 0 THEN 1 END) AS full_price_lines,
             coalesce({fine_mean('CASE WHEN discount_percent > 0 THEN discount_percent END')}, 0e0) AS avg_discount_percent
      FROM d JOIN nm ON d.customer_code IS NOT DISTINCT FROM nm.customer_code GROUP BY d.customer_code, nm.newest_value)"""))
def x11_discount_volume_lift(e):
    return X.discount_volume_lift(e.fact, WHOLE)


@register("x22_ltv_prediction", _q(*_U1, """r AS (SELECT *, CASE WHEN date_diff('day', CAST(last_purchase_date AS DATE), DATE '2001-08-01') > 90
    THEN CASE WHEN total_revenue > 10000 THEN 'high' ELSE 'medium' END ELSE 'low' END AS churn_risk FROM items)""", select="""
SELECT customer_code, customer_name, total_revenue, total_margin, churn_risk,
       total_revenue / customer_age_days * 365 * (CASE churn_risk WHEN 'high' THEN 0.2e0 WHEN 'medium' THEN 0.5e0 ELSE 1e0 END)
         AS predicted_12m_revenue,
       total_revenue / customer_age_days * 365 * (CASE churn_risk WHEN 'high' THEN 0.2e0 WHEN 'medium' THEN 0.5e0 ELSE 1e0 END)
         * (total_margin / total_revenue) AS predicted_12m_margin,
       least(1e0, total_transactions / 24e0) AS confidence FROM r"""))
def x22_ltv_prediction(e):
    return X.ltv_prediction(e.fact, WHOLE)


from .queries_customer_product import _D4  # noqa: E402

_X9_COLUMNS = (*_X10_COLUMNS, "line_total")
_MID = "1998-04-17"  # midpoint of 1995-01-01..2001-08-01 (start + floor(days / 2))


@register("x9_cannibalisation_switching", _q(*_D4, f"""sp AS (
  SELECT customer_code, item_code, min(invoice_date) AS f, max(invoice_date) AS la FROM l GROUP BY customer_code, item_code),
sw AS (SELECT s.product_a_code, s.product_b_code, count(CASE WHEN a.la < b.f THEN 1 END) AS a2b,
              count(CASE WHEN b.la < a.f THEN 1 END) AS b2a
       FROM sc s JOIN sp a ON a.item_code = s.product_a_code
       JOIN sp b ON b.item_code = s.product_b_code AND a.customer_code IS NOT DISTINCT FROM b.customer_code
       GROUP BY s.product_a_code, s.product_b_code),
tr AS (SELECT item_code, CASE WHEN p > 0 THEN (c - p) / p * 100 ELSE 0e0 END AS trend FROM (
         SELECT item_code, coalesce({msum(f"CASE WHEN invoice_date < '{_MID}' THEN line_total END")}, 0e0) AS p,
                coalesce({msum(f"CASE WHEN invoice_date >= '{_MID}' THEN line_total END")}, 0e0) AS c
         FROM l GROUP BY item_code))""", select="""
SELECT sc.product_a_code, sc.product_a_description, sc.product_b_code, sc.product_b_description, sc.shared_customers,
       coalesce(sw.a2b, 0) AS customers_switching_from_a_to_b, coalesce(sw.b2a, 0) AS customers_switching_from_b_to_a,
       ta.trend AS product_a_revenue_trend, tb.trend AS product_b_revenue_trend
FROM sc LEFT JOIN sw ON sc.product_a_code = sw.product_a_code AND sc.product_b_code = sw.product_b_code
LEFT JOIN tr ta ON sc.product_a_code = ta.item_code LEFT JOIN tr tb ON sc.product_b_code = tb.item_code"""))
def x9_cannibalisation_switching(e):
    return X.cannibalisation_switching(e.lines(*_X9_COLUMNS), WHOLE)


from .queries_core import E1_PARTS  # noqa: E402
from .queries_trends import _T4  # noqa: E402

_WIN_ALL = "invoice_date BETWEEN '1995-01-01' AND '2001-08-01'"
_WIN_LAST_YEAR = "invoice_date BETWEEN '2000-08-02' AND '2001-08-01'"
_E1_LY = [p.replace(_WIN_ALL, _WIN_LAST_YEAR) for p in E1_PARTS]


@register("x24_dashboard_with_comparison", _q(*_E1_LY[:-1], *_T4, select=f"""
SELECT e.*, g.period_over_period_growth FROM ({_E1_LY[-1]}) e,
  (SELECT CASE WHEN cmp_revenue > 0 THEN (cur_revenue - cmp_revenue) / cmp_revenue * 100 ELSE 0e0 END
          AS period_over_period_growth FROM agg) g"""))
def x24_dashboard_with_comparison(e):
    return X.dashboard_with_comparison(e.fact, LAST_YEAR)

