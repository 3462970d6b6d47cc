"""Discount and returns analysis.

Each per-dimension analysis is one ``groupBy`` with conditional aggregates; the
reference's separate sales / returns maps merged by key are the same thing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from .facts import Analysis, DateWindow, base_filter, line_cost, newest

OVERALL_NAME = {"discount": "All Transactions", "returns": "All", "rebates": "All"}


def _dimension(dim: str, kind: str) -> tuple[F.Column, F.Column]:
    """(key, display-name aggregate) for a grouping dimension."""
    if dim == "customer":
        return F.col("customer_code"), newest("customer_name")
    if dim == "product":
        return F.col("item_code"), F.coalesce(newest("item_description"), F.lit(""))
    if dim == "month":
        key = F.substring("invoice_date", 1, 7)
        return key, F.max(key)
    return F.lit("overall"), F.lit(OVERALL_NAME[kind])


def derived_catalogue_prices(lines: DataFrame) -> DataFrame:
    """G1: per item, the highest positive unit price on qty > 0 lines lacking a positive base price."""
    base = F.col("ie_base")
    return (lines.filter((base.isNull() | (base <= 0)) & (F.col("quantity") > 0) & (F.col("unit_price") > 0))
            .groupBy("item_code").agg(F.max("unit_price").alias("derived_price")))


def discount_effectiveness(fact: DataFrame, window: DateWindow, dim: str = "customer", min_discount: float = 5,
                           min_lines: int = 5, limit: int | None = 20) -> Analysis:
    """Revenue and margin given away by discounts, per dimension."""
    lines = base_filter(fact, window, include_returns=True, include_samples=False)
    # ``base || derived``: a base price of 0 (or NULL) falls back to the derived price.
    priced = (lines.join(derived_catalogue_prices(lines), "item_code", "left")
              .withColumn("_price", F.when(F.coalesce(F.col("ie_base"), F.lit(0.0)) != 0, F.col("ie_base"))
                          .otherwise(F.col("derived_price"))))
    q, p = F.col("quantity"), F.col("_price")
    potential = q * p
    disc = F.try_divide(potential - F.col("line_total"), potential) * 100
    valid = (priced.filter(p.isNotNull() & (p > 0) & (q != 0))
             .withColumn("_potential", potential).withColumn("_disc", disc)
             .filter(F.col("_disc") >= min_discount))
    key, name = _dimension(dim, "discount")
    cost = F.when(F.coalesce(F.col("landed_cost_euro"), F.lit(0.0)) != 0, line_cost()).otherwise(F.lit(0.0))
    g = (valid.groupBy(key.alias("dimension_key"))
         .agg(name.alias("dimension_name"),
              M.js_sum("line_total").alias("revenue_with_discount"),
              M.js_sum("_potential").alias("revenue_without_discount"),
              M.js_sum(cost).alias("_cost"),
              M.fine_mean("_disc").alias("avg_discount_percent"),
              F.count(F.lit(1)).alias("transaction_count")))
    with_d = F.col("revenue_with_discount") - F.col("_cost")
    without_d = F.col("revenue_without_discount") - F.col("_cost")
    items = (g.select("dimension_key", "dimension_name", "revenue_with_discount", "revenue_without_discount",
                      "avg_discount_percent", with_d.alias("margin_with_discount"),
                      without_d.alias("margin_without_discount"),
                      F.when(without_d > 0, (without_d - with_d) / without_d * 100).otherwise(F.lit(0.0))
                      .alias("margin_erosion_percent"), "transaction_count")
             .filter(F.col("transaction_count") >= min_lines))
    ranked = items.orderBy(F.abs("margin_erosion_percent").desc_nulls_last(), F.col("dimension_key").asc_nulls_last())
    summary = items.agg(M.js_sum("revenue_with_discount").alias("total_revenue"),
                        (M.js_sum("revenue_without_discount") - M.js_sum("revenue_with_discount"))
                        .alias("total_discount_given"),
                        F.coalesce(M.fine_mean("avg_discount_percent"), F.lit(0.0)).alias("avg_discount_percent"),
                        M.js_sum(F.col("margin_without_discount") - F.col("margin_with_discount")).alias("margin_impact"))
    return Analysis(summary, ranked.limit(limit) if limit else ranked)


def high_discounts(fact: DataFrame, window: DateWindow, threshold: float = 20, limit: int | None = 20) -> Analysis:
    """Lines discounted at or above ``threshold`` (non-return, non-sample), largest first."""
    lines = base_filter(fact, window, include_returns=False, include_samples=False) \
        .filter(F.col("discount_percent") >= threshold)
    cost = F.when(F.coalesce(F.col("landed_cost_euro"), F.lit(0.0)) != 0, line_cost()).otherwise(F.lit(0.0))
    flagged = lines.select(
        "invoice_number", "invoice_date", "customer_code", "customer_name", "item_code",
        F.coalesce("item_description", F.lit("")).alias("product_description"), "quantity", "unit_price", "discount_percent",
        "line_total", (F.col("line_total") - cost).alias("margin"),
        M.margin_percent(F.col("line_total"), cost).alias("margin_percent"))
    items = M.top(flagged, "discount_percent", "desc", limit, "invoice_date", "invoice_number", "item_code",
                  "line_total", "customer_code")
    summary = flagged.agg(F.count(F.lit(1)).alias("total_transactions"),  # the lines at the threshold, not cut by a limit
                          M.js_sum("line_total").alias("total_revenue_at_risk"),
                          F.coalesce(M.fine_mean("discount_percent"), F.lit(0.0)).alias("avg_discount"),
                          F.count(F.lit(1)).alias("flagged_count"))
    return Analysis(summary, items)


def returns(fact: DataFrame, window: DateWindow, dim: str = "product", limit: int | None = 20) -> Analysis:
    """INV sales against returned value per dimension."""
    lines = base_filter(fact, window, include_returns=True, include_samples=False)
    is_sale = F.col("document_type") == "INV"
    is_ret = F.col("is_return") == 1
    key, name = _dimension(dim, "returns")
    g = (lines.filter(is_sale | is_ret).groupBy(key.alias("dimension_key"))
         .agg(name.alias("dimension_name"),
              M.js_sum(F.when(is_sale, F.col("line_total"))).alias("sales_revenue"),
              F.abs(M.js_sum(F.when(is_ret, F.col("line_total")))).alias("returns_value"),
              F.count(F.when(is_sale, 1)).alias("sales_count"),
              F.count(F.when(is_ret, 1)).alias("returns_count")))
    items = (g.filter(F.col("sales_count") > 0)
             .withColumn("return_rate_percent", F.when(F.col("sales_revenue") > 0,
                                                       F.col("returns_value") / F.col("sales_revenue") * 100)
                         .otherwise(F.lit(0.0)))
             .withColumn("net_revenue", F.col("sales_revenue") - F.col("returns_value")))
    ranked = M.top(items, "return_rate_percent", "desc", limit, "dimension_key")
    summary = (items.agg(M.js_sum("sales_revenue").alias("total_sales_revenue"),
                         M.js_sum("returns_value").alias("total_returns_value"))
               .withColumn("return_rate_percent", F.when(F.col("total_sales_revenue") > 0,
                                                         F.col("total_returns_value") / F.col("total_sales_revenue") * 100)
                           .otherwise(F.lit(0.0)))
               .withColumn("net_revenue", F.col("total_sales_revenue") - F.col("total_returns_value")))
    return Analysis(summary, ranked)


def rebates(fact: DataFrame, window: DateWindow, dim: str = "customer", limit: int | None = 20) -> Analysis:
    """Non-return credit notes against INV sales per customer / month / overall."""
    if dim == "product":  # the reference has no product rebate key; it falls back to overall
        dim = "overall"
    lines = base_filter(fact, window, include_returns=True, include_samples=False)
    is_sale = F.col("document_type") == "INV"
    is_rebate = (F.col("document_type") == "CRN") & (F.col("is_return") == 0)
    key, name = _dimension(dim, "rebates")
    cost = F.when(F.coalesce(F.col("landed_cost_euro"), F.lit(0.0)) != 0, line_cost()).otherwise(F.lit(0.0))
    g = (lines.filter(is_sale | is_rebate).groupBy(key.alias("dimension_key"))
         .agg(name.alias("dimension_name"),
              F.abs(M.js_sum(F.when(is_rebate, F.col("line_total")))).alias("rebates_given"),
              F.count(F.when(is_rebate, 1)).alias("rebate_count"),
              F.count(F.when(is_sale, 1)).alias("_sales_count"),
              M.js_sum(F.when(is_sale, F.col("line_total"))).alias("total_sales"),
              M.js_sum(F.when(is_sale, cost)).alias("_sales_cost")))
    items = (g.filter((F.col("_sales_count") > 0) & (F.col("rebate_count") > 0))
             .select("dimension_key", "dimension_name", "rebates_given", "rebate_count", "total_sales",
                     F.when(F.col("total_sales") > 0, F.col("rebates_given") / F.col("total_sales") * 100)
                     .otherwise(F.lit(0.0)).alias("rebate_percent"),
                     (F.col("total_sales") - F.col("_sales_cost")).alias("margin_before_rebate"),
                     (F.col("total_sales") - F.col("_sales_cost") - F.col("rebates_given")).alias("margin_after_rebate")))
    ranked = M.top(items, "rebates_given", "desc", limit, "dimension_key")
    summary = (items.agg(M.js_sum("rebates_given").alias("total_rebates"),
                         F.coalesce(F.sum("rebate_count"), F.lit(0)).cast("long").alias("rebate_count"),
                         M.js_sum("total_sales").alias("total_sales"))
               .withColumn("rebate_as_percent_of_sales", F.when(F.col("total_sales") > 0,
                                                                F.col("total_rebates") / F.col("total_sales") * 100)
                           .otherwise(F.lit(0.0))))
    return Analysis(summary, ranked)


def credit_notes(fact: DataFrame, window: DateWindow) -> DataFrame:
    """One-row credit-note overview (single pass of conditional aggregates)."""
    lines = base_filter(fact, window, include_returns=True, include_samples=False)
    inv = (F.col("document_type") == "INV") & (F.col("is_return") == 0)
    crn = F.col("document_type") == "CRN"
    ret, reb = crn & (F.col("is_return") == 1), crn & (F.col("is_return") == 0)
    lt = F.col("line_total")
    g = lines.agg(F.count(F.when(inv, 1)).alias("total_invoices"),
                  M.js_sum(F.when(inv, lt)).alias("total_invoice_value"),
                  F.count(F.when(crn, 1)).alias("total_credit_notes"),
                  F.abs(M.js_sum(F.when(crn, lt))).alias("total_credit_note_value"),
                  F.count(F.when(ret, 1)).alias("returns_count"),
                  F.abs(M.js_sum(F.when(ret, lt))).alias("returns_value"),
                  F.count(F.when(reb, 1)).alias("rebates_count"),
                  F.abs(M.js_sum(F.when(reb, lt))).alias("rebates_value"))
    return (g.withColumn("net_revenue", F.col("total_invoice_value") - F.col("total_credit_note_value"))
             .withColumn("credit_note_rate_percent",
                         F.when(F.col("total_invoice_value") > 0,
                                F.col("total_credit_note_value") / F.col("total_invoice_value") * 100)
                         .otherwise(F.lit(0.0))))
