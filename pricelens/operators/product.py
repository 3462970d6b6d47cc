"""Product analysis (D1 slow movers, D2 ABC mix, D3 cross-sell, D4 cannibalisation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from .combine import ranked as total_order
from .combine import side_by_side
from .facts import Analysis, DateWindow, base_filter, newest, product_sales
from .pairs import Pairs, pair_counts, pair_sums


def _lines(fact: DataFrame, window: DateWindow) -> DataFrame:
    return base_filter(fact, window, include_returns=False, include_samples=False)


def slow_movers(fact: DataFrame, window: DateWindow, max_units_per_month: float = 2, limit: int = 20,
                item_code: str | None = None) -> Analysis:
    """All products whose monthly units stay under the threshold (K13), the least-transacted listed."""
    lo, hi = window.bounds()
    months = F.greatest(F.lit(1.0), F.datediff(F.to_date(hi), F.to_date(lo)) / 30.0)
    products = product_sales(fact, window, include_returns=False, include_samples=False,
                             item_codes=[item_code] if item_code else None)
    last = _lines(fact, window).groupBy("item_code").agg(M.last_day("invoice_date").alias("_last"))
    last_sale = F.coalesce(F.col("_last"), lo)
    scored = (products.join(last, "item_code", "left")
              .select("item_code", "product_description", "transaction_count",
                      F.col("total_quantity").alias("total_quantity_sold"),
                      (F.col("total_quantity") / months).alias("avg_monthly_sales"),
                      last_sale.alias("last_sale_date"),
                      F.datediff(F.to_date(F.lit(window.as_of)), F.try_to_date(last_sale)).alias("days_since_last_sale"),
                      F.col("landed_cost_euro").alias("landed_cost"))
              .filter(F.col("avg_monthly_sales") <= max_units_per_month))
    items = scored.orderBy(F.col("transaction_count").asc_nulls_last(), F.col("item_code").asc_nulls_last()).limit(limit)
    summary = side_by_side(
        products.agg(F.count(F.lit(1)).alias("total_products")),
        scored.agg(F.count(F.lit(1)).alias("slow_moving_count"),
                   M.js_sum(F.col("landed_cost") * F.col("total_quantity_sold")).alias("total_value_at_risk")))
    return Analysis(summary, items)


def product_mix(fact: DataFrame, window: DateWindow, limit: int = 20) -> Analysis:
    """ABC classes from the running revenue share of all products (A <= 80 %, B <= 95 %)."""
    products = product_sales(fact, window, include_returns=True, include_samples=False)
    ranked = total_order(products, "total_revenue", ["item_code"], running={"_running": F.col("total_revenue")})
    total = products.agg(M.js_sum("total_revenue").alias("_total"),
                         M.js_sum(F.col("total_revenue") - F.col("total_cost")).alias("_margin"))
    cum = F.try_divide(F.col("_running"), F.col("_total")) * 100
    analysed = (side_by_side(ranked, total)
                .select("rank", "item_code", "product_description", F.col("total_revenue").alias("revenue"),
                        (F.try_divide(F.col("total_revenue"), F.col("_total")) * 100).alias("revenue_percent"),
                        (F.col("total_revenue") - F.col("total_cost")).alias("margin"),
                        M.margin_percent("total_revenue", "total_cost").alias("margin_percent"),
                        cum.alias("cumulative_revenue_percent"), "_total", "_margin")
                .withColumn("abc_classification",
                            F.when(F.col("cumulative_revenue_percent") <= 80, "A")
                            .when(F.col("cumulative_revenue_percent") <= 95, "B").otherwise("C")))
    items = analysed.filter(F.col("rank") <= limit).drop("rank", "_total", "_margin")
    summary = analysed.agg(F.count(F.lit(1)).alias("total_products"),
                           F.first("_total").alias("total_revenue"), F.first("_margin").alias("total_margin"),
                           *[F.count(F.when(F.col("abc_classification") == c, 1)).alias(f"{c.lower()}_class_count")
                             for c in "ABC"])
    return Analysis(summary, items)


BASKET = ["invoice_number", "customer_code"]


def basket_items(fact: DataFrame, window: DateWindow) -> DataFrame:
    """One row per item per basket (invoice, customer) with its line count.  Every input of the
    cross-sell analyses derives from this one aggregate."""
    return _lines(fact, window).groupBy(*BASKET, "item_code").agg(F.count(F.lit(1)).alias("_lines"))


def basket_pairs(baskets: DataFrame, min_co_occurrence: int, **options) -> Pairs:
    """Item pairs that share at least so many baskets, with these and the customers who bought both."""
    # the condition always holds; it keeps the line count in the plan, so the shuffle is the one of the item counts
    return pair_counts(baskets.where("_lines > 0"), BASKET, [
        F.count(F.lit(1)).alias("co_occurrence_count"),
        M.js_distinct_count("customer_code").alias("customers_buying_both")], min_co_occurrence, **options).where(
        F.col("co_occurrence_count") >= min_co_occurrence)


def cross_sell(fact: DataFrame, window: DateWindow, min_co_occurrence: int = 5, limit: int | None = 20) -> Analysis:
    """D3: products bought together in the same basket (invoice, customer)."""
    baskets = basket_items(fact, window)
    scored = scored_pairs(baskets, min_co_occurrence)
    desc = _lines(fact, window).groupBy("item_code").agg(F.coalesce(newest("item_description"), F.lit("")).alias("desc"))
    named = [desc.select(F.col("item_code").alias(f"product_{x}_code"), F.col("desc").alias(f"product_{x}_description"))
             for x in "ab"]
    items = M.top(scored, "co_occurrence_count", "desc", limit, "product_a_code", "product_b_code")
    items = items.join(named[0], "product_a_code").join(named[1], "product_b_code").select(
        "product_a_code", "product_a_description", "product_b_code", "product_b_description",
        "co_occurrence_count", "customers_buying_both", "confidence", "confidence_b_to_a")
    if limit:  # the joins with the names don't keep the order
        items = M.sort_by(items, "co_occurrence_count", "desc", "product_a_code", "product_b_code")
    summary = scored.agg(F.count(F.lit(1)).alias("qualifying_pairs"),
                         F.coalesce(M.fine_mean("confidence"), F.lit(0.0)).alias("avg_confidence"))
    return Analysis(summary, items)


def scored_pairs(baskets: DataFrame, min_co_occurrence: int) -> DataFrame:
    """D3's pairs with their confidence in both directions: co-occurrences to lines."""
    pairs = basket_pairs(baskets, min_co_occurrence).named("product_a_code", "product_b_code")
    lines = baskets.groupBy("item_code").agg(F.sum("_lines").alias("_lines"))
    la, lb = (lines.select(F.col("item_code").alias(f"product_{x}_code"), F.col("_lines").alias(f"_l{x}")) for x in "ab")
    return pairs.join(la, "product_a_code").join(lb, "product_b_code").select(
        "product_a_code", "product_b_code", "co_occurrence_count", "customers_buying_both",
        (F.col("co_occurrence_count") / F.col("_la") * 100).alias("confidence"),
        (F.col("co_occurrence_count") / F.col("_lb") * 100).alias("confidence_b_to_a"))


def cross_sell_total_pairs(fact: DataFrame, window: DateWindow) -> DataFrame:
    """D3 ``totalPairs``: distinct co-occurring pairs before the support filter.

    A pair's stripes meet in one task, so the pairs are told apart there and only their number leaves it."""
    pairs = pair_counts(basket_items(fact, window).where("_lines > 0"), BASKET, [F.count(F.lit(1)).alias("n")])
    return pairs.counts.agg(F.count(F.lit(1)).alias("total_pairs"))


def shared_customers(lines: DataFrame, min_shared: int, switching: bool = False, **options) -> DataFrame:
    """Item pairs (a < b by code) with at least ``min_shared`` common customers, and if ``switching`` of these
    how many stopped buying one before they began with the other."""
    keys = ["customer_code", "item_code"]
    if not switching:
        spans, conditions, carry, swapped, relate = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("_lines")), {}, [], {}, None
    else:
        day = F.unix_date(F.try_to_date("invoice_date"))  # numbers, so that the aggregate over the lines hashes
        # the condition always holds; it keeps the days in the plan, so that the lines are shuffled once for all of it
        spans = lines.groupBy(*keys).agg(F.min(day).alias("first"), F.max(day).alias("last")).where("coalesce(first <= last, true)")
        carry = ["first", "last"]
        there, back = "customers_switching_from_a_to_b", "customers_switching_from_b_to_a"
        conditions, swapped = {there: 1, back: 2}, {there: back}
        relate = lambda a, b: F.when(a["last"] < b["first"], 1).when(b["last"] < a["first"], 2).otherwise(0)
    pairs = pair_sums(spans, ["customer_code"], "shared_customers", conditions, min_shared, carry, relate=relate, **options)
    return pairs.named("product_a_code", "product_b_code", swapped)


def cannibalisation(fact: DataFrame, window: DateWindow, min_shared_customers: int = 5,
                    limit: int | None = 20) -> Analysis:
    """Pairs of all items that share customers, scored by how close their revenues are."""
    lines = _lines(fact, window)
    revenue = lines.groupBy("item_code").agg(M.js_sum("line_total").alias("revenue"))
    desc = lines.groupBy("item_code").agg(F.coalesce(newest("item_description"), F.lit("")).alias("desc"))
    ra, rb = (revenue.select(F.col("item_code").alias(f"product_{x}_code"), F.col("revenue").alias(f"product_{x}_revenue"))
              for x in "ab")
    na, nb = (desc.select(F.col("item_code").alias(f"product_{x}_code"), F.col("desc").alias(f"product_{x}_description"))
              for x in "ab")
    ra_, rb_ = F.col("product_a_revenue"), F.col("product_b_revenue")
    score = F.try_divide(F.col("shared_customers"), 1 + F.try_divide(F.abs(ra_ - rb_), F.greatest(ra_, rb_)))
    scored = (shared_customers(lines, min_shared_customers).join(ra, "product_a_code").join(rb, "product_b_code")
              .withColumn("competition_score", score))
    items = M.top(scored, "competition_score", "desc", limit, "product_a_code", "product_b_code")
    items = items.join(na, "product_a_code").join(nb, "product_b_code").select(
        "product_a_code", "product_a_description", "product_b_code", "product_b_description",
        "shared_customers", "product_a_revenue", "product_b_revenue", "competition_score")
    if limit:  # the joins with the names don't keep the order
        items = M.sort_by(items, "competition_score", "desc", "product_a_code", "product_b_code")
    both = shared_customers(lines, min_shared_customers).select(
        F.explode(F.array("product_a_code", "product_b_code")).alias("code"))  # every pair gives two rows
    summary = both.agg((F.count(F.lit(1)) / 2).cast("long").alias("total_pairs"),
                       F.countDistinct("code").alias("products_at_risk"))
    return Analysis(summary, items)
