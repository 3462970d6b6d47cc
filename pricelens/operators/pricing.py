"""Pricing analysis (R1 variance, R2 consistency, R3 catalogue compliance, R4 tier performance)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from .combine import side_by_side
from .facts import Analysis, DateWindow, base_filter, newest, product_sales

TIERS = ("ie_trade", "ie_high", "ie_mid", "ie_low", "ie_base", "ie_edm", "ie_anew")


def price_variance(fact: DataFrame, window: DateWindow, min_variance_percent: float = 5, limit: int | None = None,
                   price_tier: str = "ie_trade", item_code: str | None = None) -> Analysis:
    """Products vs their catalogue price (the chosen tier, K10); ``limit`` lists the top by revenue."""
    products = product_sales(fact, window, include_returns=True, include_samples=False,
                             item_codes=[item_code] if item_code else None, price_tier=price_tier)
    cat = F.col("catalogue_price")
    avg_price = M.average_price("total_revenue", "total_quantity")
    items = (products.filter(cat.isNotNull())
             .select("item_code", "product_description", cat.alias("catalogue_price"),
                     avg_price.alias("avg_actual_price"), (avg_price - cat).alias("price_variance"),
                     F.try_divide(avg_price - cat, cat).alias("_r"), "transaction_count", "total_revenue")
             .withColumn("variance_percent", F.col("_r") * 100).drop("_r")
             .filter(F.abs("variance_percent") >= min_variance_percent))
    summary = side_by_side(
        products.agg(F.count(F.lit(1)).alias("total_products")),
        items.agg(F.count(F.lit(1)).alias("products_with_variance"),
                  F.coalesce(M.fine_mean(F.abs("variance_percent")), F.lit(0.0)).alias("avg_variance_percent")))
    return Analysis(summary, M.top(items, "total_revenue", "desc", limit, "item_code") if limit else items)


def price_consistency(fact: DataFrame, window: DateWindow, min_variance_percent: float = 5, limit: int | None = 20,
                      customer_code: str | None = None, item_code: str | None = None,
                      min_lines: int = 3) -> Analysis:
    """R2: unit-price spread per item (per item and customer when a customer is given)."""
    lines = base_filter(fact, window, include_returns=False, include_samples=False)
    if customer_code:
        lines = lines.filter(F.col("customer_code") == customer_code)
    if item_code:
        lines = lines.filter(F.col("item_code") == item_code)
    keys = ["item_code", "customer_code"] if customer_code else ["item_code"]
    g = lines.groupBy(*keys).agg(
        F.coalesce(newest("item_description"), F.lit("")).alias("product_description"),
        *([newest("customer_name").alias("customer_name")] if customer_code else []),
        F.min("unit_price").alias("min_price"), F.max("unit_price").alias("max_price"),
        M.js_mean("unit_price").alias("avg_price"), F.count(F.lit(1)).alias("transaction_count"))
    rng = F.col("max_price") - F.col("min_price")
    g = g.withColumn("price_range", rng).withColumn(
        "variation_percent",
        F.when(F.col("avg_price") > 0, F.try_divide(rng, F.col("avg_price")) * 100).otherwise(F.lit(0.0)))
    kept = g.filter((F.col("variation_percent") >= min_variance_percent) & (F.col("transaction_count") >= min_lines))
    summary = g.agg(F.count(F.lit(1)).alias("total_products"),
                    F.count(F.when((F.col("variation_percent") >= min_variance_percent)
                                   & (F.col("transaction_count") >= min_lines), 1)).alias("products_with_inconsistency"),
                    F.coalesce(M.fine_mean(F.when((F.col("variation_percent") >= min_variance_percent)
                                                  & (F.col("transaction_count") >= min_lines),
                                                  F.col("variation_percent"))),
                               F.lit(0.0)).alias("avg_price_variation"))
    return Analysis(summary, M.top(kept, "variation_percent", "desc", limit, *keys))


def catalogue_compliance(fact: DataFrame, window: DateWindow, tolerance: float = 0.01, limit: int | None = 20,
                         customer_code: str | None = None, item_code: str | None = None) -> Analysis:
    """Share of lines priced within ``tolerance`` of the trade price, per item."""
    lines = base_filter(fact, window, include_returns=False, include_samples=False)
    if customer_code:
        lines = lines.filter(F.col("customer_code") == customer_code)
    if item_code:
        lines = lines.filter(F.col("item_code") == item_code)
    cat = F.col("ie_trade")
    ok = F.abs(F.col("unit_price") - cat) / cat <= tolerance
    per_item = (lines.filter(cat.isNotNull() & (cat != 0))
                .groupBy("item_code", cat.alias("catalogue_price"))
                .agg(F.coalesce(newest("item_description"), F.lit("")).alias("product_description"),
                     F.count(F.when(ok, 1)).alias("compliant_count"),
                     F.count(F.lit(1)).alias("_n"),
                     M.js_mean("unit_price").alias("avg_actual_price"))
                .select("item_code", "product_description", "catalogue_price", "avg_actual_price",
                        "compliant_count", (F.col("_n") - F.col("compliant_count")).alias("non_compliant_count"),
                        (F.col("compliant_count") / F.col("_n") * 100).alias("compliance_percent")))
    total = lines.agg(F.count(F.lit(1)).alias("total_transactions"))
    compliant = per_item.agg(F.coalesce(F.sum("compliant_count"), F.lit(0)).cast("long").alias("compliant_transactions"))
    summary = side_by_side(total, compliant).withColumn(
        "compliance_rate", F.when(F.col("total_transactions") > 0,
                                  F.col("compliant_transactions") / F.col("total_transactions") * 100)
        .otherwise(F.lit(0.0)))
    return Analysis(summary, M.top(per_item, "compliance_percent", "asc", limit, "item_code"))


def tier_performance(fact: DataFrame, window: DateWindow, limit: int | None = None, item_code: str | None = None) -> Analysis:
    """Products with catalogue price, actual price, revenue and margin; ``limit`` lists the top by revenue."""
    products = product_sales(fact, window, include_returns=False, include_samples=False,
                             item_codes=[item_code] if item_code else None)
    items = (products.filter(F.col("catalogue_price_trade").isNotNull())
             .select("item_code", "product_description", F.col("catalogue_price_trade").alias("catalogue_price"),
                     M.average_price("total_revenue", "total_quantity").alias("avg_actual_price"),
                     "transaction_count", F.col("total_revenue").alias("revenue"),
                     (F.col("total_revenue") - F.col("total_cost")).alias("margin")))
    summary = items.agg(M.js_sum("revenue").alias("total_revenue"), M.js_sum("margin").alias("total_margin")) \
        .withColumn("avg_margin_percent", F.when(F.col("total_revenue") > 0,
                                                 F.col("total_margin") / F.col("total_revenue") * 100)
                    .otherwise(F.lit(0.0)))
    return Analysis(summary, M.top(items, "revenue", "desc", limit, "item_code") if limit else items)
