"""Customer analysis (U1 lifetime value, U2 segmentation, U3 churn risk, U4 concentration).

Every analysis covers all customers of B2: thresholds, shares and summaries are taken
over the whole population, and ``limit`` cuts the final listing only.  Positions,
running sums and order statistics come from ``combine``, range by range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from .combine import order_statistics, side_by_side
from .combine import ranked as total_order
from .facts import Analysis, DateWindow, base_filter, customer_sales

_RANK = ["customer_code", "customer_name"]


def _purchase_dates(fact: DataFrame, window: DateWindow) -> DataFrame:
    lines = base_filter(fact, window, include_returns=False, include_samples=False)
    return lines.groupBy("customer_code").agg(M.first_day("invoice_date").alias("first_purchase_date"),
                                             M.last_day("invoice_date").alias("last_purchase_date"))


def lifetime_value(fact: DataFrame, window: DateWindow, limit: int | None = None, customer_code: str | None = None) -> Analysis:
    """Customers with first/last purchase, age, AOV and purchase frequency (the top ``limit`` by revenue)."""
    top = customer_sales(fact, window, include_returns=False, include_samples=False,
                         customer_codes=[customer_code] if customer_code else None)
    age = F.greatest(F.lit(1), F.coalesce(F.datediff(F.try_to_date("last_purchase_date"),
                                                     F.try_to_date("first_purchase_date")), F.lit(1)))
    items = (top.join(_purchase_dates(fact, window), "customer_code", "left")
             .select("customer_code", "customer_name",
                     F.coalesce("first_purchase_date", F.lit("")).alias("first_purchase_date"),
                     F.coalesce("last_purchase_date", F.lit("")).alias("last_purchase_date"),
                     age.alias("customer_age_days"), "total_revenue",
                     (F.col("total_revenue") - F.col("total_cost")).alias("total_margin"),
                     F.col("transaction_count").alias("total_transactions"),
                     F.try_divide(F.col("total_revenue"), F.col("transaction_count")).alias("avg_order_value"),
                     (F.col("transaction_count") / age * 30).alias("purchase_frequency_per_month")))
    summary = items.agg(F.count(F.lit(1)).alias("total_customers"),
                        F.coalesce(F.try_divide(M.js_sum("total_revenue"), F.count(F.lit(1))), F.lit(0.0))
                        .alias("avg_lifetime_value"),
                        M.js_sum("total_revenue").alias("total_revenue"))
    if limit or customer_code:
        items = M.top(items, "total_revenue", "desc", 1 if customer_code else limit, *_RANK)
    return Analysis(summary, items)


def _segment(value: str, high: str, mid: str) -> F.Column:
    return (F.when(F.col(value) >= F.col(high), "high").when(F.col(value) >= F.col(mid), "medium")
            .otherwise("low"))


def segmentation(fact: DataFrame, window: DateWindow, limit: int = 20) -> Analysis:
    """Revenue and margin segments from the exact 33rd/67th positions among all customers."""
    top = (customer_sales(fact, window, include_returns=False, include_samples=False)
           .select(*_RANK, "total_revenue", (F.col("total_revenue") - F.col("total_cost")).alias("margin"),
                   M.margin_percent("total_revenue", "total_cost").alias("margin_percent")))
    places = F.floor(F.col("n") * 0.33) + 1, F.floor(F.col("n") * 0.67) + 1
    thresholds = side_by_side(*[
        order_statistics(top, value, {f"{name}_p67": places[0], f"{name}_p33": places[1]})
        .select(*[F.coalesce(f"{name}_{p}", F.lit(0.0)).alias(f"{name}_{p}") for p in ("p67", "p33")])
        for value, name in (("total_revenue", "revenue"), ("margin_percent", "margin"))])
    seg = (side_by_side(top, thresholds)
           .withColumn("revenue_segment", _segment("total_revenue", "revenue_p67", "revenue_p33"))
           .withColumn("margin_segment", _segment("margin_percent", "margin_p67", "margin_p33"))
           .withColumn("combined_segment", F.concat_ws("_", F.col("revenue_segment"), F.lit("revenue"),
                                                       F.col("margin_segment"), F.lit("margin"))))
    items = (M.top(seg, "total_revenue", "desc", limit, *_RANK)
             .select(*_RANK, F.col("total_revenue").alias("revenue"), "margin", "margin_percent",
                     "revenue_segment", "margin_segment", "combined_segment"))
    summary = seg.agg(F.count(F.lit(1)).alias("total_customers"),
                      F.count(F.when(F.col("revenue_segment") == "high", 1)).alias("high_value_count"),
                      F.count(F.when(F.col("revenue_segment") == "medium", 1)).alias("medium_value_count"),
                      F.count(F.when(F.col("revenue_segment") == "low", 1)).alias("low_value_count"))
    return Analysis(summary, items)


def churn_risk(fact: DataFrame, window: DateWindow, inactivity_days: int = 90, high_value: float = 10000,
               limit: int = 20) -> Analysis:
    """Customers silent for more than ``inactivity_days``; high risk above ``high_value``."""
    top = customer_sales(fact, window, include_returns=False, include_samples=False)
    last = F.coalesce(F.col("last_purchase_date"), F.lit("1970-01-01"))
    days = F.datediff(F.to_date(F.lit(window.as_of)), F.try_to_date(last))
    scored = (top.join(_purchase_dates(fact, window), "customer_code", "left")
              .select(*_RANK, last.alias("last_purchase_date"), days.alias("days_since_last_purchase"),
                      F.col("total_revenue").alias("lifetime_revenue"),
                      (F.col("total_revenue") - F.col("total_cost")).alias("lifetime_margin"))
              .withColumn("risk_level", F.when(F.col("days_since_last_purchase") > inactivity_days,
                                               F.when(F.col("lifetime_revenue") > high_value, "high")
                                               .otherwise("medium")).otherwise("low"))
              # fixed values: the texts of the reasons
              .withColumn("risk_reason", F.when(F.col("risk_level") == "high", F.format_string(
                  "High-value customer inactive for %d days", F.col("days_since_last_purchase")))
                  .when(F.col("risk_level") == "medium", F.format_string(
                      "Inactive for %d days", F.col("days_since_last_purchase"))).otherwise("Active customer")))
    at_risk = scored.filter(F.col("risk_level") != "low")
    items = at_risk.orderBy((F.col("risk_level") == "high").desc(), F.col("lifetime_revenue").desc_nulls_last(),
                            *[F.col(c).asc_nulls_last() for c in _RANK]).limit(limit)
    summary = side_by_side(
        top.agg(F.count(F.lit(1)).alias("total_customers_analyzed")),
        at_risk.agg(F.count(F.when(F.col("risk_level") == "high", 1)).alias("high_risk_count"),
                    F.count(F.when(F.col("risk_level") == "medium", 1)).alias("medium_risk_count"),
                    M.js_sum("lifetime_revenue").alias("at_risk_revenue")))
    return Analysis(summary, items)


def concentration(fact: DataFrame, window: DateWindow, limit: int = 20) -> Analysis:
    """U4: revenue share and running share of all customers; customers needed for 80 %."""
    top = customer_sales(fact, window, include_returns=False, include_samples=False).select(*_RANK, "total_revenue")
    ranked = total_order(top, "total_revenue", _RANK, running={"_running": F.col("total_revenue")})
    total = top.agg(M.js_sum("total_revenue").alias("_total"))
    running = F.col("_running")
    shares = (side_by_side(ranked, total)
              .withColumn("revenue_percent", F.try_divide(F.col("total_revenue"), F.col("_total")) * 100)
              .withColumn("cumulative_percent", F.try_divide(running, F.col("_total")) * 100))
    items = shares.filter(F.col("rank") <= limit).select(
        "rank", *_RANK, F.col("total_revenue").alias("revenue"), "revenue_percent", "cumulative_percent")
    summary = shares.agg(
        F.count(F.lit(1)).alias("total_customers"), F.first("_total").alias("total_revenue"),
        M.js_sum(F.when(F.col("rank") <= 10, F.col("total_revenue"))).alias("top10_revenue"),
        M.js_sum(F.when(F.col("rank") <= 20, F.col("total_revenue"))).alias("top20_revenue"),
        F.coalesce(F.min(F.when(F.col("cumulative_percent") >= 80, F.col("rank"))), F.count(F.lit(1)))
        .cast("long").alias("customers_for_80_percent_revenue"))
    summary = (summary.withColumn("top10_percent", F.try_divide(F.col("top10_revenue"), F.col("total_revenue")) * 100)
               .withColumn("top20_percent", F.try_divide(F.col("top20_revenue"), F.col("total_revenue")) * 100))
    return Analysis(summary, items)
