"""Executive summary: KPI dashboard (E1) and the problem-areas report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from .combine import side_by_side
from .facts import DateWindow, base_filter, customer_sales, line_cost, WHOLE_HISTORY
from .margin import customer_profitability, product_performance


def dashboard(fact: DataFrame, window: DateWindow, top_n: int = 10) -> DataFrame:
    """13 KPIs in one row, from three passes over the non-sample lines, none of which expands them.

    The line pass computes the INV, non-return KPIs, the number of products and the return
    rate (document type CRN, K8) with conditional aggregates.  The customer pass aggregates each
    customer once, with and without returns, and feeds the top-10 share (returns off), the number
    of customers and the negative-margin KPIs (returns on, every such customer: no cap, K7).
    """
    lines = base_filter(fact, window, include_returns=True, include_samples=False)
    ret = F.col("is_return") == 1
    inv = (F.col("document_type") == "INV") & ~ret

    def on_inv(c):
        return F.when(inv, c)

    line_kpis = lines.agg(
        M.js_sum(on_inv(F.col("line_total"))).alias("total_revenue"),
        M.js_sum(on_inv(line_cost())).alias("total_cost"),
        F.count(on_inv(F.lit(1))).alias("transaction_count"),
        (F.countDistinct(on_inv(F.col("item_code")))
         + F.coalesce(F.max(F.when(inv & F.col("item_code").isNull(), 1)), F.lit(0))).cast("long").alias("unique_products"),
        M.js_sum(on_inv(F.col("discount_percent"))).alias("_discount_sum"),
        M.js_sum(F.when(ret, F.abs("line_total"))).alias("_return_amount"),
        M.js_sum(F.when(~ret, F.col("line_total"))).alias("_sales_amount"))

    all_customers = (lines.groupBy("customer_code", "customer_name")
                     .agg(M.money_sum("line_total").alias("rev_all"), M.money_sum(line_cost()).alias("cost_all"),
                          M.money_sum(F.when(~ret, F.col("line_total"))).alias("rev_noret"),
                          F.count(F.when(~ret, 1)).alias("n_noret"), F.count(on_inv(F.lit(1))).alias("n_inv")))
    per_customer = all_customers.filter(F.col("customer_code").isNotNull())
    top = (M.top(per_customer.filter(F.col("n_noret") > 0), "rev_noret", "desc", top_n,
                 "customer_code", "customer_name")
           .agg(M.js_sum("rev_noret").alias("_top_revenue")))
    invoiced, code = F.col("n_inv") > 0, F.col("customer_code")
    loss = code.isNotNull() & (M.margin_percent("rev_all", "cost_all") <= 0)
    customers = all_customers.agg(
        (F.countDistinct(F.when(invoiced, code))
         + F.coalesce(F.max(F.when(invoiced & code.isNull(), 1)), F.lit(0))).cast("long").alias("unique_customers"),
        F.count(F.when(loss, 1)).alias("negative_margin_customers_count"),
        M.js_sum(F.when(loss, M.margin("rev_all", "cost_all"))).alias("negative_margin_amount"))

    return side_by_side(line_kpis, top, customers).select(
        "total_revenue", "total_cost",
        M.margin("total_revenue", "total_cost").alias("gross_margin"),
        M.margin_percent("total_revenue", "total_cost").alias("gross_margin_percent"),
        "transaction_count", "unique_customers", "unique_products",
        M.average("total_revenue", "transaction_count").alias("avg_order_value"),
        M.percentage_of_total("_top_revenue", "total_revenue").alias("top_10_customer_concentration_percent"),
        "negative_margin_customers_count", "negative_margin_amount",
        M.percentage_of_total("_return_amount", "_sales_amount").alias("return_rate_percent"),
        M.average("_discount_sum", "transaction_count").alias("avg_discount_percent"))


def negative_margin_customers(fact: DataFrame, window: DateWindow, n: int = 10) -> DataFrame:
    """Worst customers by margin (returns on, margin % <= 0)."""
    return (customer_profitability(fact, window, include_returns=True, max_margin_percent=0,
                                   sort_by="margin", order="asc", limit=n)
            .select("customer_code", "customer_name", F.col("gross_margin").alias("margin")))


def negative_margin_products(fact: DataFrame, window: DateWindow, n: int = 10) -> DataFrame:
    """Worst products by margin (margin % <= 0, at least one line)."""
    return (product_performance(fact, window, max_margin_percent=0, min_transactions=1,
                                sort_by="margin", order="asc", limit=n)
            .select("item_code", "product_description", "margin"))


def high_discount_lines(fact: DataFrame, window: DateWindow, threshold: float = 20, n: int = 10) -> DataFrame:
    """INV non-return non-sample lines with discount above the threshold, largest first."""
    lines = base_filter(fact, window, include_returns=False, include_samples=False, document_types=("INV",))
    out = (lines.filter(F.col("discount_percent") > threshold)
           .select("invoice_number", "customer_code", "item_code", "discount_percent",
                   M.margin("line_total", F.coalesce("landed_cost_euro", F.lit(0.0)) * F.col("quantity"))
                   .alias("margin")))
    return M.top(out, "discount_percent", "desc", n, "invoice_number", "item_code", "customer_code", "margin")


def inactive_high_value(fact: DataFrame, window: DateWindow, lifetime: DateWindow | None = None,
                        inactive_days: int = 90, min_revenue: float = 10000, n: int = 10) -> DataFrame:
    """E5: customers silent for more than ``inactive_days`` with revenue above ``min_revenue``.

    Revenue and the last purchase are those of all history (K9) unless ``lifetime`` gives a
    window of its own.
    """
    lifetime = lifetime or DateWindow(*WHOLE_HISTORY, window.as_of)
    revenue = customer_sales(fact, lifetime, include_returns=False, include_samples=False)
    last = (base_filter(fact, lifetime, include_returns=False, include_samples=False, document_types=("INV",))
            .groupBy("customer_code").agg(M.last_day("invoice_date").alias("last_date")))
    out = (revenue.join(last, "customer_code")
           .select("customer_code", "customer_name",
                   F.datediff(F.to_date(F.lit(window.as_of)), F.try_to_date("last_date")).alias("days_inactive"),
                   F.col("total_revenue").alias("lifetime_revenue"))
           .filter((F.col("days_inactive") > inactive_days) & (F.col("lifetime_revenue") > min_revenue)))
    return M.top(out, "lifetime_revenue", "desc", n, "customer_code")
