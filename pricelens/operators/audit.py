"""Ad-hoc queries and audit checks (A1-A32) over the cleaned tables.

Orphan checks are anti-joins against the deduplicated dimension (one row per item),
so they never fan out; NULL sales keys survive an anti-join, as in the reference's
LEFT JOIN ... IS NULL form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import metrics as M
from .cleaning import to_long
from .combine import aggregated
from .facts import Tables


def catalogue_lookup(t: Tables, item_code: str) -> DataFrame:
    """A1: the catalogue row of one item."""
    return t.catalogue_prices.filter(F.col("item_code") == item_code).orderBy("item_code").limit(1)


def customer_summary(t: Tables, customer_code: str) -> DataFrame:
    """A2: lines, quantity and revenue of one customer, by its code and name."""
    return (t.sales.filter(F.col("customer_code") == customer_code).groupBy("customer_code", "customer_name")
            .agg(F.count(F.lit(1)).alias("transaction_count"), M.money_sum("quantity").alias("total_quantity"),
                 M.money_sum("line_total").alias("total_revenue")))


def top_selling_products(t: Tables, limit: int = 10) -> DataFrame:
    """A3: products by quantity sold."""
    g = t.sales.groupBy("item_code").agg(M.money_sum("quantity").alias("total_quantity"),
                                         M.money_sum("line_total").alias("total_revenue"),
                                         F.countDistinct("customer_code").alias("unique_customers"))
    return M.top(g, "total_quantity", "desc", limit, "item_code")


def sales_with_pricing(t: Tables, item_code: str, limit: int = 100) -> DataFrame:
    """A4: one item's lines, all columns, with catalogue and cost columns, newest first."""
    s = t.sales.filter(F.col("item_code") == item_code)
    out = (s.join(t.catalogue_prices.select("item_code", "ie_trade", "ie_high"), "item_code", "left")
           .join(t.landed_costs.select("item_code", "landed_cost_euro"), "item_code", "left")
           .select(*t.sales.columns, "ie_trade", "ie_high", "landed_cost_euro"))
    return out.orderBy(F.col("invoice_date").desc(), "invoice_number", "line_total", "customer_code").limit(limit)


def customers_for_product(t: Tables, item_code: str) -> DataFrame:
    """A5: customers of one item by spend."""
    return (t.sales.filter(F.col("item_code") == item_code).groupBy("customer_code", "customer_name")
            .agg(F.count(F.lit(1)).alias("purchase_count"), M.money_sum("quantity").alias("total_quantity"),
                 M.money_sum("line_total").alias("total_spent")))


def stats_by_month(t: Tables) -> DataFrame:
    """Lines, quantity, revenue and average line per month of the dated lines."""
    dated = t.sales.filter(F.col("invoice_date").isNotNull() & (F.col("invoice_date") != ""))
    return (dated.groupBy(F.substring("invoice_date", 1, 7).alias("month"))
            .agg(F.count(F.lit(1)).alias("transaction_count"), M.money_sum("quantity").alias("total_quantity"),
                 M.money_sum("line_total").alias("total_revenue"),
                 F.try_divide(M.money_sum("line_total"), F.count("line_total")).alias("avg_line_value")))


def missing_value_profile(df: DataFrame, table: str) -> DataFrame:
    """NULL count per column of one table, as (table, column, nulls)."""
    wide = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    return to_long(wide, "column_name", "null_count").select(F.lit(table).alias("table_name"), "*")


def missing_values(raw) -> DataFrame:
    """The report over the three raw tables."""
    checked = {"sales": raw.sales_raw.select("invoice_number", "invoice_date", "customer_code", "customer_name",
                                             "item_code", "quantity", "unit_price", "line_total"),
               "catalogue_prices": raw.catalogue_prices.select("item_code", "ie_trade", "ie_high"),
               "landed_costs": raw.landed_costs.select("item_code", "landed_cost_euro")}
    return reduce(DataFrame.unionByName, [missing_value_profile(df, name) for name, df in checked.items()])


def duplicate_items(raw) -> DataFrame:
    """Repeated item codes of the three raw dimension tables."""
    checked = {"catalogue_prices": raw.catalogue_prices, "landed_costs": raw.landed_costs, "pallet_sizes": raw.pallet_sizes}
    return reduce(DataFrame.unionByName, [
        duplicate_keys(df).select(F.lit(name).alias("table_name"), "*") for name, df in checked.items()])


def duplicate_keys(df: DataFrame, key: str = "item_code") -> DataFrame:
    """Keys that appear more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences")).filter(F.col("occurrences") > 1)


def orphan_lines(t: Tables) -> DataFrame:
    """Sales lines with an item code that no catalogue row has (anti-join)."""
    return t.sales.filter(F.col("item_code").isNotNull()).join(t.catalogue_prices.select("item_code"), "item_code", "left_anti")


def orphan_item_count(t: Tables) -> DataFrame:
    """Distinct orphaned item codes (NULL ignored by COUNT DISTINCT)."""
    return orphan_lines(t).agg(F.countDistinct("item_code").alias("orphaned_item_codes"))


def orphan_item_sample(t: Tables, limit: int = 10) -> DataFrame:
    """The first orphaned item codes."""
    return orphan_lines(t).select("item_code").distinct().orderBy("item_code").limit(limit)


def orphan_customer_codes(t: Tables) -> DataFrame:
    """A10: sales customer codes missing from the customer master."""
    return (t.sales.filter(F.col("customer_code").isNotNull()).select("customer_code").distinct()
            .join(t.customers.select("customer_code"), "customer_code", "left_anti"))


def date_validation(t: Tables) -> DataFrame:
    """NULL, malformed and out-of-range (before 2000 or after 2025) dates, the number of
    lines with any of these faults, and the range of dates among them."""
    d = F.col("invoice_date")
    year = F.substring(d, 1, 4).try_cast("int")
    wrong = d.isNull() | ~d.like("____-__-__") | (year < 2000) | (year > 2025)
    return t.sales.agg(F.count(F.when(d.isNull(), 1)).alias("null_dates"),
                       F.count(F.when(d.isNotNull() & ~d.like("____-__-__"), 1)).alias("malformed_dates"),
                       F.count(F.when((year < 2000) | (year > 2025), 1)).alias("out_of_range_dates"),
                       F.count(F.when(wrong, 1)).alias("invalid_dates"),
                       F.min(F.when(wrong, d)).alias("min_date"), F.max(F.when(wrong, d)).alias("max_date"))


def non_positive_values(t) -> DataFrame:
    """Non-positive quantities, prices, catalogue tiers and costs of the raw tables."""
    s = t.sales_raw.agg(F.count(F.when(F.col("quantity") <= 0, 1)).alias("non_positive_quantity"),
                    F.count(F.when(F.col("unit_price") <= 0, 1)).alias("non_positive_price"))
    c = t.catalogue_prices.agg(*[F.count(F.when(F.col(k) <= 0, 1)).alias(f"non_positive_{k}")
                                 for k in ("ie_trade", "ie_high", "ie_mid")])
    lc = t.landed_costs.agg(F.count(F.when(F.col("landed_cost_euro") <= 0, 1)).alias("non_positive_cost"))
    return to_long(s).unionByName(to_long(c)).unionByName(to_long(lc))


def line_total_inconsistencies(t) -> DataFrame:
    """Raw lines where |line_total - quantity x price| > 0.01."""
    return t.sales_raw.agg(F.count(F.when(F.abs(F.col("line_total") - F.col("quantity") * F.col("unit_price")) > 0.01, 1))
                       .alias("inconsistent_lines"))


def name_variations_per_code(sales_raw: DataFrame) -> DataFrame:
    """Customer codes with more than one distinct name."""
    return (sales_raw.filter(F.col("customer_code").isNotNull())
            .groupBy("customer_code").agg(F.countDistinct("customer_name").alias("name_count"))
            .filter(F.col("name_count") > 1))


def whitespace_keys(sales_raw: DataFrame) -> DataFrame:
    """Codes with surrounding spaces."""
    return sales_raw.agg(
        F.count(F.when(F.col("item_code") != F.trim("item_code"), 1)).alias("item_codes_with_spaces"),
        F.count(F.when(F.col("customer_code") != F.trim("customer_code"), 1)).alias("customer_codes_with_spaces"))


def table_row_counts(t: Tables) -> DataFrame:
    """Row count of every table (UNION ALL of single-row counts)."""
    parts = [getattr(t, n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
             for n in ("sales", "catalogue_prices", "landed_costs", "customers", "pallets")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphan_summary(t: Tables) -> DataFrame:
    """Orphaned items, lines, units and revenue."""
    return orphan_lines(t).agg(F.countDistinct("item_code").alias("orphaned_items"),
                               F.count(F.lit(1)).alias("orphaned_lines"),
                               M.money_sum("quantity").alias("total_quantity"),
                               M.to_cents(M.money_sum("line_total")).alias("total_revenue"))


def orphan_items(t: Tables, limit: int = 20) -> DataFrame:
    """The orphaned items with most lines."""
    g = aggregated(
        orphan_lines(t), [F.col("item_code")],
        [F.count(F.lit(1)).alias("line_count"),
         M.money_sum("quantity").alias("total_quantity"), M.to_cents(M.money_sum("line_total")).alias("total_revenue"),
         M.to_cents(F.try_divide(M.money_sum("unit_price"), F.count("unit_price"))).alias("avg_unit_price"),
         M.first_day("invoice_date").alias("first_sale"), M.last_day("invoice_date").alias("last_sale")],
        [F.countDistinct("customer_code").alias("customer_count"),
         F.countDistinct("invoice_number").alias("invoice_count")])
    return M.top(g, "line_count", "desc", limit, "item_code")


def orphan_negative_revenue(t: Tables, limit: int = 20) -> DataFrame:
    """Orphaned items by the revenue of their negative lines, the most negative first."""
    g = orphan_lines(t).filter(F.col("line_total") < 0).groupBy("item_code").agg(
        F.count(F.lit(1)).alias("line_count"), M.money_sum("quantity").alias("total_quantity"),
        M.to_cents(M.money_sum("line_total")).alias("total_revenue"),
        M.to_cents(F.try_divide(M.money_sum("unit_price"), F.count("unit_price"))).alias("avg_unit_price"))
    return M.top(g, "total_revenue", "asc", limit, "item_code")


def orphans_by_customer(t: Tables, limit: int = 20) -> DataFrame:
    """Customers with most orphaned lines."""
    g = orphan_lines(t).groupBy("customer_code", "customer_name").agg(
        F.count(F.lit(1)).alias("orphaned_lines"), F.countDistinct("item_code").alias("orphaned_items"),
        M.to_cents(M.money_sum("line_total")).alias("orphaned_revenue"))
    return M.top(g, "orphaned_lines", "desc", limit, "customer_code", "customer_name")


def orphans_by_month(t: Tables) -> DataFrame:
    """Orphaned lines and revenue per month."""
    o = orphan_lines(t).filter(F.col("invoice_date").isNotNull() & (F.col("invoice_date") != ""))
    return o.groupBy(F.substring("invoice_date", 1, 7).alias("month")).agg(
        F.countDistinct("item_code").alias("orphaned_items"), F.count(F.lit(1)).alias("orphaned_lines"),
        M.money_sum("quantity").alias("total_quantity"), M.to_cents(M.money_sum("line_total")).alias("orphaned_revenue"))


def catalogue_never_sold(t: Tables, limit: int | None = None) -> DataFrame:
    """Catalogue items without a sale, with their tiers."""
    out = t.catalogue_prices.join(t.sales.select("item_code"), "item_code", "left_anti").select(
        "item_code", "ie_trade", "ie_high", "ie_mid", "ie_low")
    return out.orderBy("item_code").limit(limit) if limit else out


def invoice_orphan_breakdown(t: Tables) -> DataFrame:
    """Per invoice, lines, orphaned lines, orphaned revenue and its share."""
    cat = t.catalogue_prices.select("item_code", F.lit(True).alias("_listed"))
    j = t.sales.join(cat, "item_code", "left")
    orphan = F.col("_listed").isNull()
    g = j.groupBy("invoice_number").agg(
        F.count(F.lit(1)).alias("total_lines"), F.count(F.when(orphan, 1)).alias("orphaned_lines"),
        M.js_sum(F.when(orphan, F.col("line_total"))).alias("orphaned_revenue"),
        M.js_sum("line_total").alias("invoice_revenue"))
    return g.withColumn("orphaned_revenue_percent", M.percentage_of_total("orphaned_revenue", "invoice_revenue"))


def invoice_lines_excluding_samples(t: Tables) -> DataFrame:
    """A25."""
    return t.sales.filter((F.col("document_type") == "INV") & (F.col("is_sample") == 0))


def net_revenue_per_customer(t: Tables) -> DataFrame:
    """Revenue without returned lines."""
    return t.sales.groupBy("customer_code", "customer_name").agg(
        M.js_sum(F.when(F.col("is_return") == 0, F.col("line_total")).otherwise(F.lit(0.0))).alias("net_revenue"))


def metre_sales(t: Tables) -> DataFrame:
    """A27."""
    return t.sales.filter(F.col("unit_type") == "meter").select("invoice_number", "item_code", "quantity", "unit_type")


def quality_issue_lines(t: Tables) -> DataFrame:
    """A28."""
    return t.sales.filter(F.col("data_quality_issue").isNotNull()).select(
        "invoice_number", "item_code", "quantity", "data_quality_issue")


def pure_sales_by_customer_name(t: Tables) -> DataFrame:
    """INV, no return / rebate / sample: quantity x price per customer name."""
    s = t.sales.filter((F.col("document_type") == "INV") & (F.col("is_return") == 0) & (F.col("is_rebate") == 0)
                       & (F.col("is_sample") == 0))
    return s.groupBy("customer_name").agg(M.money_sum(F.col("quantity") * F.col("unit_price")).alias("pure_sales_revenue"))


def high_markup_products(t: Tables, min_markup: float = 20) -> DataFrame:
    """Catalogue items whose markup over landed cost exceeds ``min_markup`` %."""
    j = t.catalogue_prices.join(t.landed_costs.select("item_code", "landed_cost_euro"), "item_code")
    mk = F.try_divide(F.col("ie_trade") - F.col("landed_cost_euro"), F.col("landed_cost_euro")) * 100
    return j.select("item_code", "ie_trade", "landed_cost_euro", mk.alias("markup_percent")).filter(
        F.col("markup_percent") > min_markup)


def top_customers_by_revenue(t: Tables, limit: int = 10) -> DataFrame:
    """A31."""
    g = t.sales.filter(F.col("customer_code").isNotNull()).groupBy("customer_code", "customer_name").agg(
        F.count(F.lit(1)).alias("transaction_count"), M.money_sum("quantity").alias("total_quantity"),
        M.money_sum("line_total").alias("total_revenue"))
    return M.top(g, "total_revenue", "desc", limit, "customer_code")


def month_over_month(t: Tables) -> DataFrame:
    """``LAG(total_revenue) OVER (ORDER BY month)`` over the monthly view (one row per month)."""
    m = t.sales.filter(F.col("invoice_date").isNotNull()).groupBy(F.substring("invoice_date", 1, 7).alias("month")).agg(
        M.money_sum("quantity").alias("total_quantity"), M.money_sum("line_total").alias("total_revenue"))
    return m.withColumn("previous_revenue", F.lag("total_revenue").over(W.orderBy("month")))


LINE_COLUMNS = ["invoice_number", "invoice_date", "customer_code", "item_code", "quantity", "unit_price", "line_total"]


def row_samples(t: Tables, item_code: str, customer_code: str, n: int = 5) -> dict[str, DataFrame]:
    """(a) lines with quantity <= 0, (b) lines with price <= 0 (first ``n`` of each,
    in a total order), (c) the catalogue rows of one code, (d) blank pallet codes,
    (e) name counts of one customer."""
    order = [F.col(c).asc_nulls_last() for c in LINE_COLUMNS]
    raw_pallets = t.raw.pallet_sizes if t.raw is not None else t.pallets
    return {
        "a": t.sales.filter(F.col("quantity") <= 0).select(*LINE_COLUMNS).orderBy(*order).limit(n),
        "b": t.sales.filter(F.col("unit_price") <= 0).select(*LINE_COLUMNS).orderBy(*order).limit(n),
        "c": t.catalogue_prices.filter(F.col("item_code") == item_code),
        "d": raw_pallets.filter(F.col("item_code").isNull() | (F.trim("item_code") == "")).limit(n),
        "e": t.sales.filter(F.col("customer_code") == customer_code).groupBy("customer_name")
              .agg(F.count(F.lit(1)).alias("occurrences")),
    }


def raw_row_samples(raw, item_code: str, customer_code: str, n: int = 5) -> dict[str, DataFrame]:
    """A16 on the raw tables, before cleaning removes duplicate catalogue rows, name variations
    and blank codes; (a), (b) and (d) are the first ``n`` rows in a total order."""
    sales = raw.sales_raw
    order = [F.col(c).asc_nulls_last() for c in LINE_COLUMNS]
    pallets = raw.pallet_sizes.filter(F.col("item_code").isNull() | (F.trim("item_code") == ""))
    return {
        "a": sales.filter(F.col("quantity") <= 0).select(*LINE_COLUMNS).orderBy(*order).limit(n),
        "b": sales.filter(F.col("unit_price") <= 0).select(*LINE_COLUMNS).orderBy(*order).limit(n),
        "c": raw.catalogue_prices.filter(F.col("item_code") == item_code),
        "d": pallets.orderBy(*[F.col(c).asc_nulls_last() for c in pallets.columns]).limit(n),
        "e": sales.filter(F.col("customer_code") == customer_code).groupBy("customer_name")
                  .agg(F.count(F.lit(1)).alias("occurrences")),
    }
