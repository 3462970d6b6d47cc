"""Margin analysis (M1 customer profitability, M2 product performance)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from .facts import DateWindow, customer_sales, product_sales


def _margin_band(df: DataFrame, min_margin_percent=None, max_margin_percent=None) -> DataFrame:
    if min_margin_percent is not None:
        df = df.filter(F.col("margin_percent") >= min_margin_percent)
    if max_margin_percent is not None:
        df = df.filter(F.col("margin_percent") <= max_margin_percent)
    return df


_CUSTOMER_SORT = {"margin": "gross_margin", "revenue": "total_revenue", "margin_percent": "margin_percent",
                  "quantity": "total_quantity"}


def customer_profitability(fact: DataFrame, window: DateWindow, include_returns: bool = False,
                           sort_by: str = "margin", order: str = "desc", limit: int | None = 100,
                           min_margin_percent=None, max_margin_percent=None, min_revenue=None,
                           min_transactions=None) -> DataFrame:
    """M1: B2 without samples -> margin, margin %, average order value; band filter; top-n."""
    base = customer_sales(fact, window, include_returns=include_returns, include_samples=False,
                          min_revenue=min_revenue, min_transactions=min_transactions)
    out = base.select(
        "customer_code", "customer_name", "total_revenue", "total_cost",
        M.margin("total_revenue", "total_cost").alias("gross_margin"),
        M.margin_percent("total_revenue", "total_cost").alias("margin_percent"),
        "transaction_count", "unique_products",
        M.average("total_revenue", "transaction_count").alias("avg_order_value"),
        "total_quantity")
    out = _margin_band(out, min_margin_percent, max_margin_percent)
    return M.top(out, _CUSTOMER_SORT[sort_by], order, limit, "customer_code", "customer_name")


_PRODUCT_SORT = {"revenue": "revenue", "margin": "margin", "quantity": "quantity_sold",
                 "margin_percent": "margin_percent"}


def product_performance(fact: DataFrame, window: DateWindow, sort_by: str = "revenue", order: str = "desc",
                        limit: int | None = 100, min_margin_percent=None, max_margin_percent=None,
                        min_revenue=None, min_transactions=None, include_returns: bool = True,
                        include_samples: bool = True) -> DataFrame:
    """M2: B3 with returns and samples included (K6) -> margin metrics; band filter; top-n."""
    base = product_sales(fact, window, include_returns=include_returns, include_samples=include_samples,
                         min_revenue=min_revenue, min_transactions=min_transactions)
    out = base.select(
        "item_code", "product_description",
        F.col("total_quantity").alias("quantity_sold"),
        F.col("total_revenue").alias("revenue"),
        F.col("total_cost").alias("cost"),
        M.margin("total_revenue", "total_cost").alias("margin"),
        M.margin_percent("total_revenue", "total_cost").alias("margin_percent"),
        "unique_customers", "transaction_count",
        M.average("total_quantity", "transaction_count").alias("avg_order_quantity"))
    out = _margin_band(out, min_margin_percent, max_margin_percent)
    return M.top(out, _PRODUCT_SORT[sort_by], order, limit, "item_code")
