"""Registered queries: the groupings and options of the analyses beyond their defaults."""

from __future__ import annotations

from ..operators import discount, pricing, trends
from .oracle_base import fine_mean, lines, msum, newest, with_base
from .queries_discount import G2_COLUMNS, _COST, _G1
from .queries_trends import LAST_YEAR, T3_COLUMNS, T6_COLUMNS, _T3, _T4, _T5, _T6, _t2
from .registry import WHOLE, register


def _q(*ctes: str, select: str) -> str:
    return with_base("".join(", " + c for c in ctes) + "\n" + select)


_DATE = "CAST(invoice_date AS DATE)"

# --- T1: buckets of the calendar ------------------------------------------------------------
_BUCKETS = {
    "daily": ("day", "iso", f"strftime({_DATE}, '%Y-%m-%d')"),
    "yearly": ("year", "iso", f"strftime({_DATE}, '%Y')"),
    "week_of_month": ("week", "reference", f"strftime({_DATE}, '%Y') || '-W' || lpad(CAST(CAST(ceil((day({_DATE}) "
                      f"+ dayofweek(date_trunc('month', {_DATE}))) / 7e0) AS INTEGER) AS VARCHAR), 2, '0')"),
}
for _name, (_by, _mode, _expr) in _BUCKETS.items():
    register(f"t1_t2_sales_trend_{_name}", _q(*_t2(_expr), select="SELECT * FROM periods"))(
        lambda e, by=_by, mode=_mode: trends.sales_trend(e.fact, WHOLE, by, week_mode=mode).items)

# --- T3: seasons -------------------------------------------------------------------------------
for _by, _expr in (("quarter", f"'Q' || CAST(quarter({_DATE}) AS VARCHAR)"), ("weekday", f"strftime({_DATE}, '%A')")):
    _t3 = tuple(c.replace("strftime(CAST(invoice_date AS DATE), '%B')", _expr) for c in _T3)
    register(f"t3_seasonality_by_{_by}", _q(*_t3, select="""
SELECT period_key, avg_revenue, min_revenue, max_revenue, std_deviation, transaction_count, seasonality_index,
       seasonality_index_ref,
       CASE WHEN seasonality_index > 1.2 THEN 'High Season' WHEN seasonality_index < 0.8 THEN 'Low Season'
            ELSE 'Average' END AS interpretation FROM pat"""))(
        lambda e, by=_by: trends.seasonality(e.lines(*T3_COLUMNS), WHOLE, by).items)

# --- T4: other comparison windows, and returns counted ----------------------------------------
_GROWTH = """
SELECT metric, current_value, comparison_value, current_value - comparison_value AS absolute_change,
       CASE WHEN comparison_value > 0 THEN (current_value - comparison_value) / comparison_value * 100 ELSE 0e0 END AS percent_change,
       CASE WHEN current_value > comparison_value THEN 'up' WHEN current_value < comparison_value THEN 'down' ELSE 'flat' END AS trend
FROM m"""


def _t4(clo: str, chi: str):
    return tuple(c.replace("CAST(s - INTERVAL (date_diff('day', s, e) + 1) DAY AS DATE)::VARCHAR AS clo", f"{clo} AS clo")
                 .replace("CAST(s - INTERVAL 1 DAY AS DATE)::VARCHAR AS chi", f"{chi} AS chi") for c in _T4)


@register("t4_growth_year_over_year", _q(*_t4("CAST(s - INTERVAL 12 MONTH AS DATE)::VARCHAR",
                                              "CAST(e - INTERVAL 12 MONTH AS DATE)::VARCHAR"), select=_GROWTH))
def t4_growth_year_over_year(e):
    return trends.growth(e.fact, LAST_YEAR, "year_over_year").items


@register("t4_growth_custom", _q(*_t4("'1998-01-01'", "'1998-12-31'"), select=_GROWTH))
def t4_growth_custom(e):
    return trends.growth(e.fact, LAST_YEAR, "custom", "1998-01-01", "1998-12-31").items


def _with_returns(ctes):
    return tuple(c.replace(" AND is_sample = 0 AND is_return = 0)", " AND is_sample = 0)")
                 .replace(lines(returns=False, samples=False), lines(returns=True, samples=False)) for c in ctes)


@register("t4_growth_with_returns", _q(*_with_returns(_T4), select=_GROWTH))
def t4_growth_with_returns(e):
    return trends.growth(e.fact, LAST_YEAR, include_returns=True).items


@register("t5_forecast_with_returns", _q(*_with_returns(_T5), select="""
SELECT based_on_periods AS historical_periods, 3 AS forecast_periods, avg_revenue AS avg_historical_revenue,
       avg_revenue * growth_factor * 3 AS total_forecasted_revenue FROM st2"""))
def t5_forecast_with_returns(e):
    return trends.forecast(e.lines(*T6_COLUMNS), WHOLE, include_returns=True).summary


@register("t6_margin_trend_with_returns", _q(*_with_returns(_T6), select="SELECT * FROM periods"))
def t6_margin_trend_with_returns(e):
    return trends.margin_trend(e.lines(*T6_COLUMNS), WHOLE, include_returns=True).items


# --- G2, G4, G5: every dimension ---------------------------------------------------------------
def _names(dim: str, table: str, overall: str) -> tuple[str, str, str, str]:
    """Key, name, an extra CTE and a join for a dimension of the lines in ``table``."""
    if dim == "month":
        return "substr(invoice_date, 1, 7)", "substr(invoice_date, 1, 7)", "", ""
    if dim == "overall":
        return "'overall'", f"'{overall}'", "", ""
    column, name = ("customer_code", "customer_name") if dim == "customer" else ("item_code", "item_description")
    value = "nm.newest_value" if dim == "customer" else "coalesce(nm.newest_value, '')"
    return (f"{table}.{column}", value, ", " + newest(name, column, table, "nm"),
            f" JOIN nm ON {table}.{column} IS NOT DISTINCT FROM nm.{column}")


def _g2(dim: str) -> str:
    key, name, extra, join = _names(dim, "v2", "All Transactions")
    return _q(*_G1, f"""pr AS (SELECT l.*, CASE WHEN coalesce(ie_base, 0e0) <> 0 THEN ie_base ELSE dp.derived_price END AS price
       FROM l LEFT JOIN dp ON l.item_code = dp.item_code),
v AS (SELECT *, quantity * price AS potential, (quantity * price - line_total) / (quantity * price) * 100 AS disc
      FROM pr WHERE price IS NOT NULL AND price > 0 AND quantity <> 0),
v2 AS (SELECT * FROM v WHERE disc >= 5e0){extra},
g AS (SELECT {key} AS dimension_key, {name} AS dimension_name,
         coalesce({msum('line_total')}, 0e0) AS revenue_with_discount, coalesce({msum('potential')}, 0e0) AS revenue_without_discount,
         coalesce({msum(_COST)}, 0e0) AS cost, {fine_mean('disc')} AS avg_discount_percent, count(*) AS transaction_count
      FROM v2{join} GROUP BY 1, 2)""", select="""
SELECT dimension_key, dimension_name, revenue_with_discount, revenue_without_discount, avg_discount_percent,
       revenue_with_discount - cost AS margin_with_discount, revenue_without_discount - cost AS margin_without_discount,
       CASE WHEN revenue_without_discount - cost > 0
            THEN ((revenue_without_discount - cost) - (revenue_with_discount - cost)) / (revenue_without_discount - cost) * 100
            ELSE 0e0 END AS margin_erosion_percent, transaction_count
FROM g WHERE transaction_count >= 5""")


for _dim in ("product", "month", "overall"):
    register(f"g2_discount_effectiveness_by_{_dim}", _g2(_dim))(
        lambda e, dim=_dim: discount.discount_effectiveness(e.lines(*G2_COLUMNS[dim]), WHOLE, dim=dim, limit=None).items)


def _g4(dim: str) -> str:
    key, name, extra, join = _names(dim, "l", "All")
    return _q(f"""l AS (SELECT * FROM fact WHERE {lines(returns=True, samples=False)}
       AND (document_type = 'INV' OR is_return = 1)){extra},
g AS (SELECT {key} AS dimension_key, {name} AS dimension_name,
         coalesce({msum("CASE WHEN document_type = 'INV' THEN line_total END")}, 0e0) AS sales_revenue,
         abs(coalesce({msum('CASE WHEN is_return = 1 THEN line_total END')}, 0e0)) AS returns_value,
         count(CASE WHEN document_type = 'INV' THEN 1 END) AS sales_count,
         count(CASE WHEN is_return = 1 THEN 1 END) AS returns_count
      FROM l{join} GROUP BY 1, 2)""", select="""
SELECT *, CASE WHEN sales_revenue > 0 THEN returns_value / sales_revenue * 100 ELSE 0e0 END AS return_rate_percent,
       sales_revenue - returns_value AS net_revenue FROM g WHERE sales_count > 0""")


for _dim in ("customer", "overall"):
    register(f"g4_returns_by_{_dim}", _g4(_dim))(
        lambda e, dim=_dim: discount.returns(e.fact, WHOLE, dim=dim, limit=None).items)


@register("g5_rebates_by_month", _q(f"""l AS (SELECT * FROM fact WHERE {lines(returns=True, samples=False)}
       AND (document_type = 'INV' OR (document_type = 'CRN' AND is_return = 0))),
g AS (SELECT substr(invoice_date, 1, 7) AS dimension_key, substr(invoice_date, 1, 7) AS dimension_name,
         abs(coalesce({msum("CASE WHEN document_type = 'CRN' THEN line_total END")}, 0e0)) AS rebates_given,
         count(CASE WHEN document_type = 'CRN' THEN 1 END) AS rebate_count,
         count(CASE WHEN document_type = 'INV' THEN 1 END) AS sales_count,
         coalesce({msum("CASE WHEN document_type = 'INV' THEN line_total END")}, 0e0) AS total_sales,
         coalesce({msum(f"CASE WHEN document_type = 'INV' THEN {_COST} END")}, 0e0) AS sales_cost
      FROM l GROUP BY 1)""", select="""
SELECT dimension_key, dimension_name, rebates_given, rebate_count, total_sales,
       CASE WHEN total_sales > 0 THEN rebates_given / total_sales * 100 ELSE 0e0 END AS rebate_percent,
       total_sales - sales_cost AS margin_before_rebate, total_sales - sales_cost - rebates_given AS margin_after_rebate
FROM g WHERE sales_count > 0 AND rebate_count > 0"""))
def g5_rebates_by_month(e):
    return discount.rebates(e.fact, WHOLE, dim="month", limit=None).items


# --- R2: one customer -----------------------------------------------------------------------------
@register("r2_price_consistency_of_customer", _q(
    f"l AS (SELECT * FROM fact WHERE {lines(returns=False, samples=False)} AND customer_code = 'C1')",
    newest("item_description", "item_code", "l", "nd"), newest("customer_name", "item_code", "l", "nc"), f"""g AS (
  SELECT item_code, customer_code, min(unit_price) AS min_price, max(unit_price) AS max_price,
         coalesce({msum('unit_price')}, 0e0) / count(*) AS avg_price, count(*) AS transaction_count
  FROM l GROUP BY item_code, customer_code),
g2 AS (SELECT g.*, max_price - min_price AS price_range, coalesce(nd.newest_value, '') AS product_description,
              nc.newest_value AS customer_name,
              CASE WHEN avg_price > 0 THEN (max_price - min_price) / avg_price * 100 ELSE 0e0 END AS variation_percent
       FROM g JOIN nd ON g.item_code IS NOT DISTINCT FROM nd.item_code
              JOIN nc ON g.item_code IS NOT DISTINCT FROM nc.item_code)""",
    select="SELECT * FROM g2 WHERE variation_percent >= 0 AND transaction_count >= 1"))
def r2_price_consistency_of_customer(e):
    return pricing.price_consistency(e.fact, WHOLE, min_variance_percent=0, min_lines=1, limit=None,
                                     customer_code="C1").items
