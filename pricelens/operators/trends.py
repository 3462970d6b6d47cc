"""Trends and forecasting (T2 sales trend, T3 seasonality, T4 growth, T5 forecast, T6 margin trend).

Per-period aggregates are bounded by the calendar (one row per day/week/month...),
so the ordered windows over them (lag, last-n) run on small inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.periods import period_key, season_key
from .combine import aggregated, side_by_side
from .facts import Analysis, DateWindow, base_filter

def _cost() -> F.Column:
    return (F.when(F.coalesce(F.col("landed_cost_euro"), F.lit(0.0)) != 0,
                   F.col("quantity") * F.col("landed_cost_euro")).otherwise(F.lit(0.0)))


def _per_period(lines: DataFrame, group_by: str, week_mode: str = "iso") -> DataFrame:
    return aggregated(
        lines.withColumn("period", period_key("invoice_date", group_by, week_mode)), [F.col("period")],
        [M.js_sum("line_total").alias("revenue"), M.js_sum(_cost()).alias("cost"),
         F.count(F.lit(1)).alias("transaction_count")],
        [M.js_distinct_count("customer_code").alias("unique_customers"),
         M.js_distinct_count("item_code").alias("unique_products")])


def sales_trend(fact: DataFrame, window: DateWindow, group_by: str = "month", include_returns: bool = False,
                week_mode: str = "iso") -> Analysis:
    """Revenue, cost, margin and growth per period."""
    lines = base_filter(fact, window, include_returns=include_returns, include_samples=False)
    per = _per_period(lines, group_by, week_mode)
    prev = F.lag("revenue").over(W.orderBy("period"))
    periods = per.select(
        "period", "revenue", "cost", (F.col("revenue") - F.col("cost")).alias("margin"),
        M.margin_percent("revenue", "cost").alias("margin_percent"), "transaction_count", "unique_customers",
        "unique_products", (F.col("revenue") / F.col("transaction_count")).alias("avg_order_value"),
        F.when(prev.isNull(), F.lit(None).cast("double"))
         .when(prev > 0, (F.col("revenue") - prev) / prev * 100).otherwise(F.lit(0.0)).alias("growth_rate_percent"))
    first_rev = F.min_by("revenue", "period")
    last_rev = F.max_by("revenue", "period")
    summary = periods.agg(M.js_sum("revenue").alias("total_revenue"), M.js_sum("margin").alias("total_margin"),
                          F.count(F.lit(1)).alias("period_count"), first_rev.alias("_first"), last_rev.alias("_last"))
    summary = summary.select(
        "total_revenue", "total_margin",
        F.when(F.col("total_revenue") > 0, F.col("total_margin") / F.col("total_revenue") * 100)
         .otherwise(F.lit(0.0)).alias("avg_margin_percent"),
        "period_count",
        F.when((F.col("period_count") > 1) & (F.col("_first") > 0),
               (F.col("_last") - F.col("_first")) / F.col("_first") * 100).otherwise(F.lit(0.0))
         .alias("overall_growth_rate"))
    return Analysis(summary, periods)


def seasonality(fact: DataFrame, window: DateWindow, group_by: str = "month", include_returns: bool = False) -> Analysis:
    """Per-season line statistics and seasonality index.

    ``seasonality_index`` is the season's total over the mean season total;
    ``seasonality_index_ref`` is the reference's per-line mean over the mean season
    total (K16).  NULL line totals count as 0 (N2).
    """
    lines = base_filter(fact, window, include_returns=include_returns, include_samples=False)
    v = F.coalesce(F.col("line_total"), F.lit(0.0))
    per = (lines.groupBy(season_key("invoice_date", group_by).alias("period_key"))
           .agg(M.js_sum(v).alias("_total"), F.count(F.lit(1)).alias("transaction_count"),
                F.min(v).alias("min_revenue"), F.max(v).alias("max_revenue"),
                M.exact_stddev_pop(v).alias("std_deviation")))
    overall = per.agg((M.js_sum("_total") / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("_avg_overall"))
    idx_ref = F.when(F.col("_avg_overall") > 0, F.col("avg_revenue") / F.col("_avg_overall")).otherwise(F.lit(1.0))
    idx = F.when(F.col("_avg_overall") > 0, F.col("_total") / F.col("_avg_overall")).otherwise(F.lit(1.0))
    patterns = (side_by_side(per, overall)
                .withColumn("avg_revenue", F.col("_total") / F.col("transaction_count"))
                .withColumn("seasonality_index", idx).withColumn("seasonality_index_ref", idx_ref)
                .withColumn("interpretation", F.when(F.col("seasonality_index") > 1.2, "High Season")
                            .when(F.col("seasonality_index") < 0.8, "Low Season").otherwise("Average")))
    summary = patterns.agg(F.count(F.lit(1)).alias("total_periods"), F.first("_avg_overall").alias("avg_revenue"),
                           F.max("seasonality_index").alias("highest_seasonality_index"),
                           F.min("seasonality_index").alias("lowest_seasonality_index"))
    items = patterns.select("period_key", "avg_revenue", "min_revenue", "max_revenue", "std_deviation",
                            "transaction_count", "seasonality_index", "seasonality_index_ref", "interpretation")
    return Analysis(summary, items)


def comparison_window(window: DateWindow, comparison_type: str = "previous_period",
                      comparison_start: str | None = None, comparison_end: str | None = None) -> tuple[F.Column, F.Column]:
    """T4 comparison bounds: the same length ending the day before, the same dates a year
    earlier, or explicit dates."""
    lo, hi = window.bounds()
    start, end = F.to_date(lo), F.to_date(hi)
    if comparison_type == "previous_period":
        duration = F.datediff(end, start)
        return F.date_sub(start, duration + 1).cast("string"), F.date_sub(start, 1).cast("string")
    if comparison_type == "year_over_year":
        return F.add_months(start, -12).cast("string"), F.add_months(end, -12).cast("string")
    return F.lit(comparison_start), F.lit(comparison_end)


@dataclass(frozen=True)
class _Both(DateWindow):
    """A window and a second one: from the first to the last day of either, so only these years are read."""
    other: tuple[F.Column, F.Column] = ()

    def bounds(self) -> tuple[F.Column, F.Column]:
        lo, hi = super().bounds()
        return F.least(lo, self.other[0]), F.greatest(hi, self.other[1])


_METRICS = [("Revenue", "revenue"), ("Margin", "margin"), ("Transactions", "transactions"),
            ("Unique Customers", "customers"), ("Average Order Value", "aov")]


def growth(fact: DataFrame, window: DateWindow, comparison_type: str = "previous_period",
           comparison_start: str | None = None, comparison_end: str | None = None,
           include_returns: bool = False) -> Analysis:
    """T4: five metrics for the current window against the comparison window: a pass
    for the sums, and one that marks each customer's windows for the customer counts."""
    lo, hi = window.bounds()
    clo, chi = comparison_window(window, comparison_type, comparison_start, comparison_end)
    lines = base_filter(fact, _Both(window.start, window.end, window.as_of, (clo, chi)),
                        include_returns=include_returns, include_samples=False)
    d = F.col("invoice_date")
    cur, cmp_ = d.between(lo, hi), d.between(clo, chi)

    def block(cond, p):
        return [M.js_sum(F.when(cond, F.col("line_total"))).alias(f"{p}_revenue"),
                M.js_sum(F.when(cond, _cost())).alias(f"{p}_cost"),
                F.count(F.when(cond, 1)).alias(f"{p}_transactions")]
    lines = lines.filter(cur | cmp_)
    customers = lines.groupBy("customer_code").agg(F.max(cur).alias("_cur"), F.max(cmp_).alias("_cmp")).agg(
        F.count(F.when(F.col("_cur"), 1)).alias("cur_customers"), F.count(F.when(F.col("_cmp"), 1)).alias("cmp_customers"))
    agg = side_by_side(lines.agg(*block(cur, "cur"), *block(cmp_, "cmp")), customers)
    for p in ("cur", "cmp"):
        agg = (agg.withColumn(f"{p}_margin", F.col(f"{p}_revenue") - F.col(f"{p}_cost"))
                  .withColumn(f"{p}_aov", F.col(f"{p}_revenue") / F.greatest(F.lit(1), F.col(f"{p}_transactions"))))
    stack = "stack(5, " + ", ".join(
        f"'{label}', cast(cur_{k} as double), cast(cmp_{k} as double)" for label, k in _METRICS
    ) + ") as (metric, current_value, comparison_value)"
    metrics = agg.selectExpr(stack).select(
        "metric", "current_value", "comparison_value",
        (F.col("current_value") - F.col("comparison_value")).alias("absolute_change"),
        F.when(F.col("comparison_value") > 0, (F.col("current_value") - F.col("comparison_value"))
               / F.col("comparison_value") * 100).otherwise(F.lit(0.0)).alias("percent_change"),
        F.when(F.col("current_value") > F.col("comparison_value"), "up")
         .when(F.col("current_value") < F.col("comparison_value"), "down").otherwise("flat").alias("trend"))
    summary = agg.select(
        F.lit(comparison_type).alias("comparison_type"), F.col("cur_revenue").alias("current_period_revenue"),
        F.col("cmp_revenue").alias("comparison_period_revenue"),
        F.when(F.col("cmp_revenue") > 0, (F.col("cur_revenue") - F.col("cmp_revenue")) / F.col("cmp_revenue") * 100)
         .otherwise(F.lit(0.0)).alias("overall_growth_percent"))
    return Analysis(summary, metrics)


def forecast(fact: DataFrame, window: DateWindow, group_by: str = "month", periods: int = 3,
             recent: int = 3, include_returns: bool = False) -> Analysis:
    """T5: flat forecast = mean per-period value x (mean of the last ``recent`` / mean of all)."""
    lines = base_filter(fact, window, include_returns=include_returns, include_samples=False)
    per = (lines.groupBy(period_key("invoice_date", group_by).alias("period"))
           .agg(M.js_sum("line_total").alias("revenue"), M.js_sum(_cost()).alias("_cost"))
           .withColumn("margin", F.col("revenue") - F.col("_cost"))
           .withColumn("_from_end", F.row_number().over(W.orderBy(F.col("period").desc()))))
    stats = per.agg(F.count(F.lit(1)).alias("based_on_periods"), F.max("period").alias("_last"),
                    (M.js_sum("revenue") / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("avg_revenue"),
                    (M.js_sum("margin") / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("avg_margin"),
                    (M.js_sum(F.when(F.col("_from_end") <= recent, F.col("revenue")))
                     / F.greatest(F.lit(1), F.count(F.when(F.col("_from_end") <= recent, 1)))).alias("recent_avg"))
    stats = stats.withColumn("growth_factor", F.when(F.col("avg_revenue") > 0,
                                                     F.col("recent_avg") / F.col("avg_revenue")).otherwise(F.lit(1.0)))
    steps = stats.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    items = steps.select(
        F.concat(F.coalesce("_last", F.lit("")), F.lit("+"), F.col("i").cast("string")).alias("period"),
        (F.col("avg_revenue") * F.col("growth_factor")).alias("forecasted_revenue"),
        (F.col("avg_margin") * F.col("growth_factor")).alias("forecasted_margin"),
        F.when(F.col("i") > 2, "low").when(F.col("i") > 1, "medium").otherwise("high").alias("confidence_level"),
        "based_on_periods")
    summary = stats.select(F.col("based_on_periods").alias("historical_periods"),
                           F.lit(periods).alias("forecast_periods"),
                           F.col("avg_revenue").alias("avg_historical_revenue"),
                           (F.col("avg_revenue") * F.col("growth_factor") * periods).alias("total_forecasted_revenue"))
    return Analysis(summary, items)


def margin_trend(fact: DataFrame, window: DateWindow, group_by: str = "month", threshold: float = 2,
                 include_returns: bool = False) -> Analysis:
    """Margin % per period; improving / declining when last - first moves by > threshold points."""
    lines = base_filter(fact, window, include_returns=include_returns, include_samples=False)
    per = (lines.groupBy(period_key("invoice_date", group_by).alias("period"))
           .agg(M.js_sum("line_total").alias("revenue"), M.js_sum(_cost()).alias("cost"),
                F.count(F.lit(1)).alias("transaction_count")))
    periods = per.select("period", "revenue", "cost", (F.col("revenue") - F.col("cost")).alias("margin"),
                         M.margin_percent("revenue", "cost").alias("margin_percent"), "transaction_count")
    s = periods.agg(F.count(F.lit(1)).alias("period_count"),
                    M.js_sum("revenue").alias("total_revenue"), M.js_sum("margin").alias("total_margin"),
                    F.min_by("margin_percent", "period").alias("first_margin_percent"),
                    F.max_by("margin_percent", "period").alias("last_margin_percent"))
    change = F.col("last_margin_percent") - F.col("first_margin_percent")
    summary = s.select("period_count", "total_revenue", "total_margin",
                       F.when(F.col("total_revenue") > 0, F.col("total_margin") / F.col("total_revenue") * 100)
                       .otherwise(F.lit(0.0)).alias("avg_margin_percent"),
                       "first_margin_percent", "last_margin_percent",
                       F.coalesce(change, F.lit(0.0)).alias("margin_change"),
                       F.when((F.col("period_count") >= 3) & (change > threshold), "improving")
                        .when((F.col("period_count") >= 3) & (change < -threshold), "declining")
                        .otherwise("stable").alias("trend"))
    return Analysis(summary, periods)
