"""Summary views V1-V8 (raw and cleaned forms)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from .combine import aggregated
from .facts import Tables


def product_pricing_raw(catalogue: DataFrame, costs: DataFrame, pallets: DataFrame) -> DataFrame:
    """V1: catalogue ⟕ landed costs ⟕ pallet sizes on item_code (raw tables may fan out)."""
    return (catalogue.join(costs.select("item_code", "landed_cost_euro", "plus_5_percent"), "item_code", "left")
            .join(pallets, "item_code", "left"))


def sales_by_customer_raw(sales_raw: DataFrame) -> DataFrame:
    """V2: per (code, name): invoices, lines, quantity, revenue, average line, first / last date."""
    return (sales_raw.filter(F.col("customer_code").isNotNull())
            .groupBy("customer_code", "customer_name")
            .agg(F.countDistinct("invoice_number").alias("total_invoices"),
                 F.count(F.lit(1)).alias("total_line_items"),
                 M.money_sum("quantity").alias("total_quantity"),
                 M.money_sum("line_total").alias("total_revenue"),
                 F.try_divide(M.money_sum("line_total"), F.count("line_total")).alias("avg_line_value"),
                 M.first_day("invoice_date").alias("first_purchase_date"),
                 M.last_day("invoice_date").alias("last_purchase_date")))


def _greatest_names(sales: DataFrame) -> DataFrame:
    """The greatest name of each item, over the distinct pairs: text aggregates sort every row."""
    return (sales.select(F.col("item_code").alias("_item"), "item_description").distinct()
            .groupBy("_item").agg(F.max("item_description").alias("item_description")))


def sales_by_product_raw(sales_raw: DataFrame, catalogue: DataFrame, costs: DataFrame) -> DataFrame:
    """V3: per item: customers, invoices, quantity, revenue, average unit price, then the
    (deduplicated) catalogue and cost columns.  Aggregating before the join avoids the
    fan-out of the raw view (K4); the name is taken over the distinct (item, name) pairs."""
    agg = aggregated(
        sales_raw, [F.col("item_code")],
        [M.money_sum("quantity").alias("total_quantity"), M.money_sum("line_total").alias("total_revenue"),
         F.try_divide(M.money_sum("unit_price"), F.count("unit_price")).alias("avg_unit_price")],
        [F.countDistinct("customer_code").alias("unique_customers"),
         F.countDistinct("invoice_number").alias("total_invoices")])
    names = _greatest_names(sales_raw)
    agg = agg.join(names, F.col("item_code").eqNullSafe(F.col("_item")), "left").select(
        "item_code", "item_description", "unique_customers", "total_invoices", "total_quantity", "total_revenue",
        "avg_unit_price")
    return (agg.join(catalogue.select("item_code", "ie_trade", "ie_base"), "item_code", "left")
            .join(costs.select("item_code", "landed_cost_euro"), "item_code", "left"))


def monthly_sales_raw(sales_raw: DataFrame) -> DataFrame:
    """V4: per ``yyyy-MM`` (dates not blank): customers, invoices, lines, quantity, revenue, average line."""
    dated = (sales_raw.filter(F.col("invoice_date").isNotNull() & (F.col("invoice_date") != ""))
             .withColumn("month", F.date_format(F.try_to_date("invoice_date"), "yyyy-MM")))
    return aggregated(
        dated, [F.col("month")],
        [F.count(F.lit(1)).alias("total_line_items"), M.money_sum("quantity").alias("total_quantity"),
         M.money_sum("line_total").alias("total_revenue"),
         F.try_divide(M.money_sum("line_total"), F.count("line_total")).alias("avg_line_value")],
        [F.countDistinct("customer_code").alias("unique_customers"),
         F.countDistinct("invoice_number").alias("total_invoices")])


def product_pricing(t: Tables) -> DataFrame:
    """V5: trade price, landed cost, margin and markup (margin / cost, K5) per catalogue item."""
    cost, trade = F.col("landed_cost_euro"), F.col("ie_trade")
    return (t.catalogue_prices.join(t.landed_costs.select("item_code", "landed_cost_euro"), "item_code", "left")
            .select("item_code", trade.alias("catalogue_price"), cost.alias("landed_cost"),
                    (trade - cost).alias("margin"),
                    F.when(cost > 0, (trade - cost) / cost * 100).alias("margin_percentage")))


def sales_by_customer(t: Tables) -> DataFrame:
    """V6: per cleaned (code, name), NULL codes kept."""
    return (t.sales.groupBy("customer_code", "customer_name")
            .agg(F.count(F.lit(1)).alias("transaction_count"), M.money_sum("quantity").alias("total_quantity"),
                 M.money_sum("line_total").alias("total_revenue")))


def sales_by_product(t: Tables) -> DataFrame:
    """V7: per cleaned item: lines, quantity, revenue, average unit price."""
    lines = (t.sales.groupBy("item_code")
             .agg(F.count(F.lit(1)).alias("transaction_count"), M.money_sum("quantity").alias("total_quantity"),
                  M.money_sum("line_total").alias("total_revenue"),
                  F.try_divide(M.money_sum("unit_price"), F.count("unit_price")).alias("avg_unit_price")))
    return lines.join(_greatest_names(t.sales), F.col("item_code").eqNullSafe(F.col("_item")), "left").select(
        "item_code", "item_description", "transaction_count", "total_quantity", "total_revenue", "avg_unit_price")


def monthly_sales(t: Tables) -> DataFrame:
    """V8: per month of the cleaned sales (NULL month kept)."""
    return (t.sales.groupBy(F.date_format(F.try_to_date("invoice_date"), "yyyy-MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("transaction_count"), M.money_sum("quantity").alias("total_quantity"),
                 M.money_sum("line_total").alias("total_revenue")))


def register_views(spark, t: Tables) -> None:
    """Expose the cleaned tables and views to ``spark.sql``."""
    for name in ("sales", "landed_costs", "catalogue_prices", "customers", "pallets"):
        getattr(t, name).createOrReplaceTempView(name)
    product_pricing(t).createOrReplaceTempView("vw_product_pricing")
    sales_by_customer(t).createOrReplaceTempView("vw_sales_by_customer")
    sales_by_product(t).createOrReplaceTempView("vw_sales_by_product")
    monthly_sales(t).createOrReplaceTempView("vw_monthly_sales")
