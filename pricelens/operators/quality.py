"""Data-quality analysis (Q1 anomalies, Q2 quality summary, Q3 orphaned products)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from .combine import side_by_side
from .facts import Analysis, DateWindow, base_filter, product_sales

SEVERITY_RANK = {"high": 3, "medium": 2, "low": 1}


def _sev(value, high: float, medium: float, below: bool = False) -> F.Column:
    if below:
        return F.when(value < high, "high").when(value < medium, "medium").otherwise("low")
    return F.when(value > high, "high").when(value > medium, "medium").otherwise("low")


def anomalies(fact: DataFrame, window: DateWindow, limit: int | None = 50, min_lines: int = 5) -> Analysis:
    """Q1: unusual price (|z| > 2.5), quantity (|z| > 3), discount (> 40 %) and below-cost lines.

    Per-item statistics are a partially aggregated ``groupBy`` joined back to the
    lines (not a window over each item), so a hot item is never sorted in one task.
    """
    lines = base_filter(fact, window, include_returns=False, include_samples=False)
    p = F.coalesce(F.col("unit_price"), F.lit(0.0))
    q = F.coalesce(F.col("quantity"), F.lit(0.0))
    stats = (lines.groupBy("item_code")
             .agg(F.count(F.lit(1)).alias("_n"), M.exact_mean(p).alias("_pa"), M.exact_stddev_pop(p).alias("_ps"),
                  M.exact_mean(q).alias("_qa"), M.exact_stddev_pop(q).alias("_qs"))
             .filter(F.col("_n") >= min_lines))
    # lines without an item are a group of their own
    j = lines.join(stats.withColumnRenamed("item_code", "_item"), F.col("item_code").eqNullSafe(F.col("_item"))).drop("_item")
    lt = F.coalesce(F.col("line_total"), F.lit(0.0))
    lc = F.coalesce(F.col("landed_cost_euro"), F.lit(0.0))
    cost = q * lc
    mp = M.margin_percent(lt, cost)
    # an item's mean can be 0: its deviation is then unknown, and of the lowest severity
    pdev = F.abs(F.try_divide(p - F.col("_pa"), F.col("_pa")) * 100)
    qdev = F.abs(F.try_divide(q - F.col("_qa"), F.col("_qa")) * 100)

    def anomaly(kind, cond, expected, actual, deviation, severity):
        return F.when(cond, F.struct(F.lit(kind).alias("anomaly_type"), expected.cast("double").alias("expected_value"),
                                     actual.cast("double").alias("actual_value"), deviation.alias("deviation_percent"),
                                     severity.alias("severity")))
    found = F.array(
        anomaly("unusual_price", (F.col("_ps") > 0) & (F.abs(p - F.col("_pa")) / F.col("_ps") > 2.5),
                F.col("_pa"), p, pdev, _sev(pdev, 100, 50)),
        anomaly("unusual_quantity", (F.col("_qs") > 0) & (F.abs(q - F.col("_qa")) / F.col("_qs") > 3),
                F.col("_qa"), q, qdev, _sev(qdev, 200, 100)),
        anomaly("unusual_discount", F.col("discount_percent") > 40, F.lit(None), F.col("discount_percent"),
                F.col("discount_percent"), _sev(F.col("discount_percent"), 60, 50)),
        anomaly("negative_margin", (lc != 0) & (lt - cost < 0), F.lit(None), lt - cost, F.abs(mp),
                _sev(mp, -20, -10, below=True)))
    rows = (j.select("invoice_number", "invoice_date", "customer_code", "customer_name", "item_code",
                     F.coalesce("item_description", F.lit("")).alias("product_description"),
                     F.explode(F.filter(found, lambda x: x.isNotNull())).alias("a"))
            .select("invoice_number", "invoice_date", "customer_code", "customer_name", "item_code",
                    "product_description", "a.*"))
    sev_rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    items = rows.orderBy(sev_rank.desc(), F.col("deviation_percent").desc_nulls_last(),
                         *[F.col(c).asc_nulls_last() for c in ("invoice_number", "item_code", "anomaly_type",
                                                               "invoice_date", "customer_code", "actual_value")])
    items = items.limit(limit) if limit else items
    summary = side_by_side(
        lines.agg(F.count(F.lit(1)).alias("total_transactions_analyzed")),
        rows.agg(F.count(F.lit(1)).alias("anomalies_detected"),
                 F.count(F.when(F.col("severity") == "high", 1)).alias("high_severity_count"))
    ).withColumn("anomaly_rate", F.when(F.col("total_transactions_analyzed") > 0,
                                        F.col("anomalies_detected") / F.col("total_transactions_analyzed") * 100)
                 .otherwise(F.lit(0.0)))
    return Analysis(summary, items)


# Issue types, descriptions and impacts of the quality summary.
ISSUES = [
    ("missing_cost", "Transactions with missing landed cost data", "high"),
    ("missing_catalogue_price", "Transactions with missing catalogue price", "medium"),
    ("missing_description", "Transactions with missing product description", "low"),
    ("zero_quantity", "Transactions with zero or negative quantity", "high"),
    ("zero_price", "Transactions with zero or negative unit price", "high"),
    ("samples", "Sample transactions (not revenue)", "low"),
    ("returns", "Return transactions (negative revenue)", "medium"),
]


def quality_summary(fact: DataFrame, window: DateWindow) -> Analysis:
    """Q2: seven issue counters over all lines (returns and samples included); zero counts omitted."""
    lines = base_filter(fact, window, include_returns=True, include_samples=True)
    conds = {
        "missing_cost": F.col("landed_cost_euro").isNull(),
        "missing_catalogue_price": F.col("ie_trade").isNull(),
        "missing_description": F.col("item_description").isNull() | (F.trim("item_description") == ""),
        "zero_quantity": M.js_le_zero("quantity"),
        "zero_price": M.js_le_zero("unit_price"),
        "samples": F.col("is_sample") == 1,
        "returns": F.col("is_return") == 1,
    }
    issue_row = (conds["missing_cost"] | conds["missing_catalogue_price"] | conds["zero_quantity"]
                 | conds["zero_price"])
    wide = lines.agg(F.count(F.lit(1)).alias("_total"),
                     *[F.count(F.when(c, 1)).alias(k) for k, c in conds.items()],
                     (F.countDistinct(F.when(issue_row, F.col("invoice_number")))
                      + F.max(F.when(issue_row & F.col("invoice_number").isNull(), 1).otherwise(0)))
                     .alias("_records"))
    stack = "stack({}, {}) as (issue_type, count, description, impact)".format(
        len(ISSUES), ", ".join(f"'{k}', `{k}`, '{d}', '{i}'" for k, d, i in ISSUES))
    issues = (wide.selectExpr("_total", stack).filter(F.col("count") > 0)
              .select("issue_type", "count", (F.col("count") / F.col("_total") * 100).alias("percent_of_total"),
                      "description", "impact"))
    summary = wide.select(F.col("_total").alias("total_sales_records"), F.col("_records").alias("records_with_issues"),
                          F.when(F.col("_total") > 0, F.col("_records") / F.col("_total") * 100)
                          .otherwise(F.lit(0.0)).alias("issue_rate"))
    return Analysis(summary, issues.orderBy(F.col("count").desc(), "issue_type"))


def orphaned_products(fact: DataFrame, window: DateWindow, limit: int | None = 50) -> Analysis:
    """Q3: sold items lacking a landed cost and/or a trade price, by revenue."""
    products = product_sales(fact, window, include_returns=False, include_samples=False)
    has_cost, has_cat = F.col("landed_cost_euro").isNotNull(), F.col("catalogue_price_trade").isNotNull()
    orphaned = (products.filter(~has_cost | ~has_cat)
                .select("item_code", "product_description", F.lit(True).alias("in_sales"),
                        has_cost.alias("has_cost"), has_cat.alias("has_catalogue"),
                        F.when(~has_cost & ~has_cat, "missing_cost_and_catalogue")
                         .when(~has_cost, "missing_cost").otherwise("missing_catalogue").alias("issue_type"),
                        "transaction_count", "total_revenue"))
    items = M.top(orphaned, "total_revenue", "desc", limit, "item_code")
    summary = products.agg(F.count(F.lit(1)).alias("total_products"),
                           F.count(F.when(~has_cost | ~has_cat, 1)).alias("products_with_issues"),
                           F.count(F.when(~has_cost, 1)).alias("missing_cost_count"),
                           F.count(F.when(~has_cat, 1)).alias("missing_catalogue_count"))
    return Analysis(summary, items)
