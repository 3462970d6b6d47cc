"""Registered queries: trends and forecasting."""

from __future__ import annotations

from ..operators import trends
from ..operators.facts import LINE_COLUMNS, DateWindow
from .oracle_base import exact_std, lines, margin_pct, msum, with_base
from .registry import AS_OF, WHOLE, register

T3_COLUMNS = (*LINE_COLUMNS, "line_total")
T6_COLUMNS = (*T3_COLUMNS, "quantity", "landed_cost_euro")  # of T5, too

LAST_YEAR = DateWindow("2000-08-02", "2001-08-01", AS_OF)


def _q(*ctes: str, select: str) -> str:
    return with_base("".join(", " + c for c in ctes) + "\n" + select)


_COST = "CASE WHEN coalesce(landed_cost_euro, 0e0) <> 0 THEN quantity * landed_cost_euro ELSE 0e0 END"


def _t2(period_expr: str):
    return (f"""per AS (
  SELECT {period_expr} AS period, coalesce({msum('line_total')}, 0e0) AS revenue, coalesce({msum(_COST)}, 0e0) AS cost,
         count(*) AS transaction_count,
         count(DISTINCT customer_code) + max(CASE WHEN customer_code IS NULL THEN 1 ELSE 0 END) AS unique_customers,
         count(DISTINCT item_code) + max(CASE WHEN item_code IS NULL THEN 1 ELSE 0 END) AS unique_products
  FROM fact WHERE {lines(returns=False, samples=False)} GROUP BY 1),
periods AS (
  SELECT period, revenue, cost, revenue - cost AS margin, {margin_pct('revenue', 'cost')} AS margin_percent,
         transaction_count, unique_customers, unique_products, revenue / transaction_count AS avg_order_value,
         CASE WHEN lag(revenue) OVER (ORDER BY period) IS NULL THEN NULL
              WHEN lag(revenue) OVER (ORDER BY period) > 0
              THEN (revenue - lag(revenue) OVER (ORDER BY period)) / lag(revenue) OVER (ORDER BY period) * 100
              ELSE 0e0 END AS growth_rate_percent
  FROM per)""",)


_MONTH = "strftime(CAST(invoice_date AS DATE), '%Y-%m')"
_ISO_WEEK = "strftime(CAST(invoice_date AS DATE), '%G-W%V')"


@register("t2_sales_trend_monthly", _q(*_t2(_MONTH), select="SELECT * FROM periods"))
def t2_sales_trend_monthly(e):
    return trends.sales_trend(e.fact, WHOLE, "month").items


@register("t2_sales_trend_monthly_summary", _q(*_t2(_MONTH), select=f"""
SELECT total_revenue, total_margin,
       CASE WHEN total_revenue > 0 THEN total_margin / total_revenue * 100 ELSE 0e0 END AS avg_margin_percent,
       period_count,
       CASE WHEN period_count > 1 AND first_rev > 0 THEN (last_rev - first_rev) / first_rev * 100 ELSE 0e0 END
         AS overall_growth_rate
FROM (SELECT coalesce({msum('revenue')}, 0e0) AS total_revenue, coalesce({msum('margin')}, 0e0) AS total_margin,
             count(*) AS period_count, arg_min(revenue, period) AS first_rev, arg_max(revenue, period) AS last_rev
      FROM periods)"""))
def t2_sales_trend_monthly_summary(e):
    return trends.sales_trend(e.fact, WHOLE, "month").summary


@register("t1_t2_sales_trend_iso_weekly", _q(*_t2(_ISO_WEEK), select="SELECT * FROM periods"))
def t1_t2_sales_trend_iso_weekly(e):
    return trends.sales_trend(e.fact, WHOLE, "week").items


@register("t1_t2_sales_trend_quarterly", _q(*_t2("strftime(CAST(invoice_date AS DATE), '%Y') || '-Q' || quarter(CAST(invoice_date AS DATE))"),
                                             select="SELECT * FROM periods"))
def t1_t2_sales_trend_quarterly(e):
    return trends.sales_trend(e.fact, WHOLE, "quarter").items


_T3 = (f"""per AS (
  SELECT strftime(CAST(invoice_date AS DATE), '%B') AS period_key, coalesce({msum('coalesce(line_total, 0e0)')}, 0e0) AS total,
         count(*) AS transaction_count, min(coalesce(line_total, 0e0)) AS min_revenue, max(coalesce(line_total, 0e0)) AS max_revenue,
         {exact_std('coalesce(line_total, 0e0)')} AS std_deviation
  FROM fact WHERE {lines(returns=False, samples=False)} GROUP BY 1),
ov AS (SELECT coalesce({msum('total')}, 0e0) / greatest(1, count(*)) AS avg_overall FROM per),
pat AS (SELECT period_key, total / transaction_count AS avg_revenue, min_revenue, max_revenue, std_deviation, transaction_count,
               CASE WHEN avg_overall > 0 THEN total / avg_overall ELSE 1e0 END AS seasonality_index,
               CASE WHEN avg_overall > 0 THEN (total / transaction_count) / avg_overall ELSE 1e0 END AS seasonality_index_ref,
               avg_overall
        FROM per, ov)""",)


@register("t3_seasonality", _q(*_T3, select="""
SELECT period_key, avg_revenue, min_revenue, max_revenue, std_deviation, transaction_count, seasonality_index,
       seasonality_index_ref,
       CASE WHEN seasonality_index > 1.2 THEN 'High Season' WHEN seasonality_index < 0.8 THEN 'Low Season'
            ELSE 'Average' END AS interpretation FROM pat"""))
def t3_seasonality(e):
    return trends.seasonality(e.lines(*T3_COLUMNS), WHOLE, "month").items


@register("t3_seasonality_summary", _q(*_T3, select="""
SELECT count(*) AS total_periods, first(avg_overall) AS avg_revenue, max(seasonality_index) AS highest_seasonality_index,
       min(seasonality_index) AS lowest_seasonality_index FROM pat"""))
def t3_seasonality_summary(e):
    return trends.seasonality(e.lines(*T3_COLUMNS), WHOLE, "month").summary


_T4 = (f"""l AS (SELECT * FROM fact WHERE document_type IN ('INV', 'CRN') AND is_sample = 0 AND is_return = 0),
b AS (SELECT DATE '2000-08-02' AS s, DATE '2001-08-01' AS e),
w AS (SELECT CAST(s AS VARCHAR) AS lo, CAST(e AS VARCHAR) AS hi,
             CAST(s - INTERVAL (date_diff('day', s, e) + 1) DAY AS DATE)::VARCHAR AS clo,
             CAST(s - INTERVAL 1 DAY AS DATE)::VARCHAR AS chi FROM b),
agg AS (
  SELECT coalesce({msum("CASE WHEN invoice_date BETWEEN lo AND hi THEN line_total END")}, 0e0) AS cur_revenue,
         coalesce({msum(f"CASE WHEN invoice_date BETWEEN lo AND hi THEN {_COST} END")}, 0e0) AS cur_cost,
         count(CASE WHEN invoice_date BETWEEN lo AND hi THEN 1 END) AS cur_transactions,
         count(DISTINCT CASE WHEN invoice_date BETWEEN lo AND hi THEN customer_code END)
           + max(CASE WHEN invoice_date BETWEEN lo AND hi AND customer_code IS NULL THEN 1 ELSE 0 END) AS cur_customers,
         coalesce({msum("CASE WHEN invoice_date BETWEEN clo AND chi THEN line_total END")}, 0e0) AS cmp_revenue,
         coalesce({msum(f"CASE WHEN invoice_date BETWEEN clo AND chi THEN {_COST} END")}, 0e0) AS cmp_cost,
         count(CASE WHEN invoice_date BETWEEN clo AND chi THEN 1 END) AS cmp_transactions,
         count(DISTINCT CASE WHEN invoice_date BETWEEN clo AND chi THEN customer_code END)
           + max(CASE WHEN invoice_date BETWEEN clo AND chi AND customer_code IS NULL THEN 1 ELSE 0 END) AS cmp_customers
  FROM l, w WHERE invoice_date BETWEEN lo AND hi OR invoice_date BETWEEN clo AND chi),
m AS (
  SELECT 'Revenue' AS metric, cur_revenue AS current_value, cmp_revenue AS comparison_value FROM agg
  UNION ALL SELECT 'Margin', cur_revenue - cur_cost, cmp_revenue - cmp_cost FROM agg
  UNION ALL SELECT 'Transactions', CAST(cur_transactions AS DOUBLE), CAST(cmp_transactions AS DOUBLE) FROM agg
  UNION ALL SELECT 'Unique Customers', CAST(cur_customers AS DOUBLE), CAST(cmp_customers AS DOUBLE) FROM agg
  UNION ALL SELECT 'Average Order Value', cur_revenue / greatest(1, cur_transactions), cmp_revenue / greatest(1, cmp_transactions) FROM agg)""",)


@register("t4_growth_previous_period", _q(*_T4, select="""
SELECT metric, current_value, comparison_value, current_value - comparison_value AS absolute_change,
       CASE WHEN comparison_value > 0 THEN (current_value - comparison_value) / comparison_value * 100 ELSE 0e0 END AS percent_change,
       CASE WHEN current_value > comparison_value THEN 'up' WHEN current_value < comparison_value THEN 'down' ELSE 'flat' END AS trend
FROM m"""))
def t4_growth_previous_period(e):
    return trends.growth(e.fact, LAST_YEAR).items


@register("t4_growth_previous_period_summary", _q(*_T4, select="""
SELECT 'previous_period' AS comparison_type, cur_revenue AS current_period_revenue, cmp_revenue AS comparison_period_revenue,
       CASE WHEN cmp_revenue > 0 THEN (cur_revenue - cmp_revenue) / cmp_revenue * 100 ELSE 0e0 END AS overall_growth_percent
FROM agg"""))
def t4_growth_previous_period_summary(e):
    return trends.growth(e.fact, LAST_YEAR).summary


_T5 = (f"""per AS (
  SELECT {_MONTH} AS period, coalesce({msum('line_total')}, 0e0) AS revenue, coalesce({msum(_COST)}, 0e0) AS cost
  FROM fact WHERE {lines(returns=False, samples=False)} GROUP BY 1),
per2 AS (SELECT *, revenue - cost AS margin, row_number() OVER (ORDER BY period DESC) AS from_end FROM per),
st AS (SELECT count(*) AS based_on_periods, max(period) AS last_period,
              coalesce({msum('revenue')}, 0e0) / greatest(1, count(*)) AS avg_revenue,
              coalesce({msum('margin')}, 0e0) / greatest(1, count(*)) AS avg_margin,
              coalesce({msum('CASE WHEN from_end <= 3 THEN revenue END')}, 0e0)
                / greatest(1, count(CASE WHEN from_end <= 3 THEN 1 END)) AS recent_avg FROM per2),
st2 AS (SELECT *, CASE WHEN avg_revenue > 0 THEN recent_avg / avg_revenue ELSE 1e0 END AS growth_factor FROM st)""",)


@register("t5_forecast", _q(*_T5, select="""
SELECT coalesce(last_period, '') || '+' || CAST(i AS VARCHAR) AS period, avg_revenue * growth_factor AS forecasted_revenue,
       avg_margin * growth_factor AS forecasted_margin,
       CASE WHEN i > 2 THEN 'low' WHEN i > 1 THEN 'medium' ELSE 'high' END AS confidence_level, based_on_periods
FROM st2, range(1, 4) t(i)"""))
def t5_forecast(e):
    return trends.forecast(e.lines(*T6_COLUMNS), WHOLE).items


@register("t5_forecast_summary", _q(*_T5, select="""
SELECT based_on_periods AS historical_periods, 3 AS forecast_periods, avg_revenue AS avg_historical_revenue,
       avg_revenue * growth_factor * 3 AS total_forecasted_revenue FROM st2"""))
def t5_forecast_summary(e):
    return trends.forecast(e.lines(*T6_COLUMNS), WHOLE).summary


_T6 = (f"""periods AS (
  SELECT period, revenue, cost, revenue - cost AS margin, {margin_pct('revenue', 'cost')} AS margin_percent, transaction_count
  FROM (SELECT {_MONTH} AS period, coalesce({msum('line_total')}, 0e0) AS revenue, coalesce({msum(_COST)}, 0e0) AS cost,
               count(*) AS transaction_count
        FROM fact WHERE {lines(returns=False, samples=False)} GROUP BY 1))""",)


@register("t6_margin_trend", _q(*_T6, select="SELECT * FROM periods"))
def t6_margin_trend(e):
    return trends.margin_trend(e.lines(*T6_COLUMNS), WHOLE).items


@register("t6_margin_trend_summary", _q(*_T6, select=f"""
SELECT period_count, total_revenue, total_margin,
       CASE WHEN total_revenue > 0 THEN total_margin / total_revenue * 100 ELSE 0e0 END AS avg_margin_percent,
       first_margin_percent, last_margin_percent, coalesce(last_margin_percent - first_margin_percent, 0e0) AS margin_change,
       CASE WHEN period_count >= 3 AND last_margin_percent - first_margin_percent > 2 THEN 'improving'
            WHEN period_count >= 3 AND last_margin_percent - first_margin_percent < -2 THEN 'declining' ELSE 'stable' END AS trend
FROM (SELECT count(*) AS period_count, coalesce({msum('revenue')}, 0e0) AS total_revenue,
             coalesce({msum('margin')}, 0e0) AS total_margin, arg_min(margin_percent, period) AS first_margin_percent,
             arg_max(margin_percent, period) AS last_margin_percent FROM periods)"""))
def t6_margin_trend_summary(e):
    return trends.margin_trend(e.lines(*T6_COLUMNS), WHOLE).summary
