"""Functions specified in the reference's function catalogue but not implemented there.

docstring states the one used.  Lines default to INV + CRN, samples and returns
excluded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..session import written_once
from .combine import ranked as total_order, with_places
from .combine import aggregated, side_by_side
from .facts import Analysis, DateWindow, base_filter, line_cost, newest, product_sales, customer_sales
from . import customer as customer_ops
from . import discount as discount_ops
from . import executive as executive_ops
from . import product as product_ops
from .margin import product_performance
from .pairs import group_sizes
from .trends import growth

FEW = 100_000  # items that may be sent to every task
TIERS = ("ie_trade", "ie_high", "ie_mid", "ie_low", "ie_base", "ie_edm", "ie_anew")


def _lines(fact: DataFrame, window: DateWindow, returns: bool = False, samples: bool = False) -> DataFrame:
    return base_filter(fact, window, include_returns=returns, include_samples=samples)


def _cost() -> F.Column:
    return line_cost()


def _margin_cols(rev: str = "revenue", cost: str = "cost") -> list:
    return [M.margin(rev, cost).alias("margin"), M.margin_percent(rev, cost).alias("margin_percent")]


def margin_by_dimension(fact: DataFrame, window: DateWindow, group_by: str = "customer", only_negative: bool = False,
                        min_margin_percent=None, max_margin_percent=None) -> DataFrame:
    """Revenue, cost, margin per customer / product / month / customer_product."""
    keys = {"customer": ["customer_code", "customer_name"], "product": ["item_code"],
            "month": [F.substring("invoice_date", 1, 7).alias("month")],
            "customer_product": ["customer_code", "customer_name", "item_code"]}[group_by]
    g = _lines(fact, window).groupBy(*keys).agg(M.js_sum("line_total").alias("revenue"), M.js_sum(_cost()).alias("cost"),
                                                F.count(F.lit(1)).alias("transaction_count"))
    out = g.select("*", *_margin_cols())
    if only_negative:
        out = out.filter(F.col("margin") < 0)
    if min_margin_percent is not None:
        out = out.filter(F.col("margin_percent") >= min_margin_percent)
    if max_margin_percent is not None:
        out = out.filter(F.col("margin_percent") <= max_margin_percent)
    return out


def customer_product_matrix(fact: DataFrame, window: DateWindow, customer_code=None, item_code=None) -> DataFrame:
    """One row per (customer, product) with margin, average price and average discount."""
    lines = _lines(fact, window)
    if customer_code:
        lines = lines.filter(F.col("customer_code") == customer_code)
    if item_code:
        lines = lines.filter(F.col("item_code") == item_code)
    g = lines.groupBy("customer_code", "customer_name", "item_code").agg(
        F.coalesce(newest("item_description"), F.lit("")).alias("product_description"),
        M.js_sum("quantity").alias("quantity_sold"), M.js_sum("line_total").alias("revenue"),
        M.js_sum(_cost()).alias("cost"), F.max("landed_cost_euro").alias("landed_cost"),
        # A line's discount is reported to 2 dp; the mean is taken over those values.
        F.coalesce(M.fine_mean(M.round_half_up("discount_percent")), F.lit(0.0)).alias("avg_discount_percent"))
    return g.select("*", *_margin_cols(), M.average_price("revenue", "quantity_sold").alias("avg_unit_price"))


def matched_tier(tolerance: float = 0.01) -> F.Column:
    """The first catalogue tier (trade, high, mid, low, base, edm, anew) within ``tolerance``."""
    expr = F.lit("custom")
    for t in reversed(TIERS):
        c = F.col(t)
        expr = F.when(c.isNotNull() & (c > 0) & (F.abs(F.col("unit_price") - c) / c <= tolerance), F.lit(t)).otherwise(expr)
    return expr


def _tier_price() -> F.Column:
    expr = F.lit(None).cast("double")
    for t in TIERS:
        expr = F.when(F.col("tier_matched") == t, F.col(t)).otherwise(expr)
    return expr


def price_tier_usage(fact: DataFrame, window: DateWindow, tolerance: float = 0.01) -> DataFrame:
    """Lines, revenue and average price per (item, matched tier)."""
    lines = _lines(fact, window).withColumn("tier_matched", matched_tier(tolerance))
    return (lines.withColumn("_tier_price", _tier_price())
            .groupBy("item_code", "tier_matched")
            .agg(F.count(F.lit(1)).alias("transaction_count"), M.js_sum("line_total").alias("total_revenue"),
                 M.js_mean("unit_price").alias("avg_actual_price"), F.max("_tier_price").alias("catalogue_price")))


def price_position(fact: DataFrame, window: DateWindow, item_code=None) -> DataFrame:
    """Spread of the average price each customer pays per item (two-level aggregate)."""
    lines = _lines(fact, window)
    if item_code:
        lines = lines.filter(F.col("item_code") == item_code)
    per_cust = lines.groupBy("item_code", "customer_code").agg(M.js_mean("unit_price").alias("cust_avg"))
    per_item = per_cust.groupBy("item_code").agg(
        F.count(F.lit(1)).alias("customer_count"), M.fine_mean("cust_avg").alias("avg_price"),
        F.min("cust_avg").alias("min_price"), F.max("cust_avg").alias("max_price"))
    desc = lines.groupBy("item_code").agg(F.coalesce(newest("item_description"), F.lit("")).alias("product_description"))
    pos = (per_cust.join(per_item.select("item_code", "avg_price"), "item_code")
           .groupBy("item_code").agg(F.count(F.when(F.col("cust_avg") < F.col("avg_price"), 1)).alias("customers_below_avg"),
                                     F.count(F.when(F.col("cust_avg") > F.col("avg_price"), 1)).alias("customers_above_avg")))
    return (per_item.join(pos, "item_code").join(desc, "item_code")
            .withColumn("price_spread", F.col("max_price") - F.col("min_price")))


def lifetime_value_annual(fact: DataFrame, window: DateWindow, limit: int | None = None) -> DataFrame:
    """U1 plus ``estimated_annual_value`` = revenue / age days x 365."""
    items = customer_ops.lifetime_value(fact, window, limit=limit).items
    return items.withColumn("estimated_annual_value",
                            F.col("total_revenue") / F.col("customer_age_days") * 365)


def churn_decline(fact: DataFrame, window: DateWindow, inactivity_days: int = 90, decline_threshold: float = 30,
                  high_value: float = 10000, history: DateWindow | None = None) -> DataFrame:
    """Revenue in the first vs second half of the window; decline % = (prev - curr) / prev x 100.

    Risk: high when inactive past ``inactivity_days`` with revenue above ``high_value``;
    medium when inactive or declining by at least ``decline_threshold`` %; low rows dropped.
    Customers, last purchases and lifetime revenue come from ``history``, by default the window alone.
    """
    lo, hi = window.bounds()
    start, end = F.to_date(lo), F.to_date(hi)
    mid = F.date_add(start, (F.datediff(end, start) / 2).cast("int")).cast("string")
    lines = _lines(fact, history or window).filter(F.col("customer_code").isNotNull())
    d = F.col("invoice_date")
    g = lines.groupBy("customer_code", "customer_name").agg(
        M.js_sum(F.when((d >= lo) & (d < mid), F.col("line_total"))).alias("previous_period_revenue"),
        M.js_sum(F.when((d >= mid) & (d <= hi), F.col("line_total"))).alias("current_period_revenue"),
        M.js_sum("line_total").alias("lifetime_revenue"), F.max(d).alias("last_purchase_date"))
    prev, curr = F.col("previous_period_revenue"), F.col("current_period_revenue")
    days = F.datediff(F.to_date(F.lit(window.as_of)), F.try_to_date("last_purchase_date"))
    out = (g.withColumn("days_since_last_purchase", days)
           .withColumn("revenue_decline_percent", F.when(prev > 0, (prev - curr) / prev * 100).otherwise(F.lit(0.0)))
           .withColumn("risk_level",
                       F.when((F.col("days_since_last_purchase") > inactivity_days)
                              & (F.col("lifetime_revenue") > high_value), "high")
                       .when((F.col("days_since_last_purchase") > inactivity_days)
                             | (F.col("revenue_decline_percent") >= decline_threshold), "medium").otherwise("low")))
    return out.filter(F.col("risk_level") != "low")


def herfindahl(fact: DataFrame, window: DateWindow) -> DataFrame:
    """Herfindahl index of customer revenue shares: shares first, so that no square of money can overflow."""
    per = customer_sales(fact, window, include_returns=False, include_samples=False)
    total = per.agg(F.count(F.lit(1)).alias("total_customers"), M.js_sum("total_revenue").alias("total_revenue"))
    share = F.try_divide(F.col("total_revenue"), F.col("_total"))
    squares = side_by_side(per.select("total_revenue"), total.select(F.col("total_revenue").alias("_total"))).agg(
        F.sum((share * share).cast("decimal(38,18)")).cast("double").alias("concentration_index"))
    return side_by_side(total, squares)


def product_ranks(fact: DataFrame, window: DateWindow) -> DataFrame:
    """M2 products with their revenue and margin ranks among all products."""
    products = product_performance(fact, window, limit=None)
    # both ranks from the products, not one from the other's result, which would be computed anew for each reading
    return with_places(with_places(products, products, "revenue", "revenue_rank"), products, "margin", "margin_rank")


def cannibalisation_switching(fact: DataFrame, window: DateWindow, min_shared_customers: int = 5,
                              limit: int | None = None) -> DataFrame:
    """D4 pairs with switching counts (A->B when the last A purchase precedes the first
    B purchase) and each product's revenue trend (second-half vs first-half growth %).

    ``limit`` keeps the pairs with the most shared customers (ties by code); without it the report
    holds every pair that shares at least ``min_shared_customers``.

    The pairs are written as a table first: where they hold at most ``FEW`` items, the lines of these only are
    shuffled for the trends."""
    lines = _lines(fact, window)
    pairs = product_ops.shared_customers(lines, min_shared_customers, switching=True)
    if limit:
        pairs = M.top(pairs, "shared_customers", "desc", limit, "product_a_code", "product_b_code")
    pairs = written_once(pairs, "pairs")
    items = pairs.select(F.explode(F.array("product_a_code", "product_b_code")).alias("item_code")).distinct()
    if items.limit(FEW + 1).count() <= FEW:
        lines = lines.join(F.broadcast(items), "item_code", "left_semi")
    lo, hi = window.bounds()
    mid = F.date_add(F.to_date(lo), (F.datediff(F.to_date(hi), F.to_date(lo)) / 2).cast("int")).cast("string")
    d = F.col("invoice_date")
    trend = (lines.groupBy("item_code")
             .agg(M.js_sum(F.when(d < mid, F.col("line_total"))).alias("_p"),
                  M.js_sum(F.when(d >= mid, F.col("line_total"))).alias("_c2"),
                  F.coalesce(newest("item_description"), F.lit("")).alias("desc"))
             .select("item_code", "desc", F.when(F.col("_p") > 0, (F.col("_c2") - F.col("_p")) / F.col("_p") * 100)
                     .otherwise(F.lit(0.0)).alias("trend")))
    ta, tb = (trend.select(F.col("item_code").alias(f"product_{x}_code"), F.col("desc").alias(f"product_{x}_description"),
                           F.col("trend").alias(f"product_{x}_revenue_trend")) for x in "ab")
    return pairs.join(ta, "product_a_code", "left").join(tb, "product_b_code", "left").select(
        "product_a_code", "product_a_description", "product_b_code", "product_b_description", "shared_customers",
        "customers_switching_from_a_to_b", "customers_switching_from_b_to_a", "product_a_revenue_trend",
        "product_b_revenue_trend")


def cross_sell_lift(fact: DataFrame, window: DateWindow, min_co_occurrence: int = 5) -> DataFrame:
    """D3 pairs with basket lift = count_ab x N / (n_a x n_b) and customer-based confidence."""
    # the conditions on counts always hold and the joins are null-safe: otherwise columns that one reading leaves out and
    # filters on the item would make shuffles of their own from the same baskets
    baskets = product_ops.basket_items(fact, window).where("_lines > 0")
    sizes = group_sizes(_lines(fact, window), product_ops.BASKET)  # of the lines, as those of a basket lie together
    support = baskets.groupBy("item_code").agg(F.count("item_code").alias("_n"), F.sum("_lines").alias("_lines"),
                                               M.js_distinct_count("customer_code").alias("_cust")).where("_cust > 0 and _lines > 0")
    pairs = product_ops.basket_pairs(baskets, min_co_occurrence, sizes=sizes, support=support.select(
        "item_code", F.col("_n").alias("_support"))).named("product_a_code", "product_b_code")
    n = sizes.where("_n > 0").agg(F.count(F.lit(1)).alias("_baskets"))
    desc = _lines(fact, window).groupBy(F.col("item_code").alias("_item")).agg(
        F.coalesce(newest("item_description"), F.lit("")).alias("desc"))
    facts = support.join(desc, F.col("item_code").eqNullSafe(F.col("_item")))
    sa = facts.select(F.col("item_code").alias("_a"), F.col("desc").alias("product_a_description"),
                      F.col("_n").alias("_na"), F.col("_cust").alias("_ca"), F.col("_lines").alias("_la"))
    sb = facts.select(F.col("item_code").alias("_b"), F.col("desc").alias("product_b_description"), F.col("_n").alias("_nb"))
    j = pairs.join(sa, F.col("product_a_code").eqNullSafe(F.col("_a"))).join(sb, F.col("product_b_code").eqNullSafe(F.col("_b")))
    j = side_by_side(j, n)
    return j.select("product_a_code", "product_a_description", "product_b_code", "product_b_description",
                    "co_occurrence_count", "customers_buying_both",
                    (F.col("co_occurrence_count") / F.col("_la") * 100).alias("confidence"),
                    (F.col("customers_buying_both") / F.col("_ca") * 100).alias("customer_confidence"),
                    (F.col("co_occurrence_count") * F.col("_baskets") / (F.col("_na") * F.col("_nb"))).alias("lift"))


def discount_volume_lift(fact: DataFrame, window: DateWindow, group_by: str = "customer") -> DataFrame:
    """X11: volumes on discounted (discount % > 0) vs undiscounted lines with a base price;
    volume lift % = (mean qty discounted - mean qty undiscounted) / mean qty undiscounted x 100."""
    lines = _lines(fact, window).filter(F.col("ie_base").isNotNull() & (F.col("ie_base") > 0) & (F.col("quantity") != 0))
    key, name = discount_ops._dimension(group_by, "discount")
    disc = F.col("discount_percent") > 0
    g = lines.groupBy(key.alias("dimension_key")).agg(
        name.alias("dimension_name"),
        M.js_sum(F.when(disc, F.col("quantity"))).alias("volume_with_discount"),
        M.js_sum(F.when(~disc, F.col("quantity"))).alias("volume_without_discount"),
        F.count(F.when(disc, 1)).alias("discounted_lines"), F.count(F.when(~disc, 1)).alias("full_price_lines"),
        F.coalesce(M.fine_mean(F.when(disc, F.col("discount_percent"))), F.lit(0.0)).alias("avg_discount_percent"))
    w_avg = F.try_divide(F.col("volume_with_discount"), F.col("discounted_lines"))
    wo_avg = F.try_divide(F.col("volume_without_discount"), F.col("full_price_lines"))
    return g.withColumn("volume_lift_percent", F.when(wo_avg > 0, (w_avg - wo_avg) / wo_avg * 100))


def sample_impact(fact: DataFrame, window: DateWindow) -> DataFrame:
    """Samples given and paid business per customer; ROI = (paid margin - sample cost) / sample cost."""
    lines = _lines(fact, window, returns=False, samples=True).filter(F.col("customer_code").isNotNull())
    s = F.col("is_sample") == 1
    g = lines.groupBy("customer_code", "customer_name").agg(
        F.count(F.when(s, 1)).alias("samples_given_count"),
        M.js_sum(F.when(s, _cost())).alias("samples_given_cost"),
        M.js_sum(F.when(~s, F.col("line_total"))).alias("total_paid_purchases_revenue"),
        M.js_sum(F.when(~s, _cost())).alias("_paid_cost"))
    g = g.filter(F.col("samples_given_count") > 0)
    margin = F.col("total_paid_purchases_revenue") - F.col("_paid_cost")
    cost = F.col("samples_given_cost")
    return g.select("customer_code", "customer_name", "samples_given_count", "samples_given_cost",
                    "total_paid_purchases_revenue", margin.alias("total_paid_purchases_margin"),
                    F.when(F.col("total_paid_purchases_revenue") != 0,
                           cost / F.col("total_paid_purchases_revenue")).alias("sample_to_revenue_ratio"),
                    F.when(cost != 0, (margin - cost) / cost).alias("estimated_roi"))


def _orders(fact: DataFrame, window: DateWindow, pallets: DataFrame) -> DataFrame:
    """Order = quantity per (invoice, item), for items with a positive pallet size."""
    lines = _lines(fact, window).filter(F.col("document_type") == "INV")
    orders = lines.groupBy("invoice_number", "customer_code", "customer_name", "item_code").agg(
        M.js_sum("quantity").alias("order_quantity"), F.count(F.lit(1)).alias("lines"))
    sizes = pallets.filter(F.col("pallet_quantity") > 0).select("item_code", "pallet_quantity")
    return orders.join(sizes, "item_code")


def pallet_optimisation(fact: DataFrame, window: DateWindow, pallets: DataFrame) -> DataFrame:
    """Orders whose quantity is a whole multiple of the pallet size, per item."""
    o = _orders(fact, window, pallets)
    match = (F.col("order_quantity") > 0) & (F.pmod(F.col("order_quantity"), F.col("pallet_quantity")) == 0)
    desc = (_lines(fact, window).groupBy("item_code")
            .agg(F.coalesce(newest("item_description"), F.lit("")).alias("product_description")))
    g = o.groupBy("item_code", "pallet_quantity").agg(
        F.try_divide(M.js_sum("order_quantity"), F.count(F.lit(1))).alias("avg_order_quantity"),
        F.count(F.when(match, 1)).alias("orders_matching_pallet"), F.count(F.lit(1)).alias("total_orders"))
    return (g.join(desc, "item_code", "left")
            .withColumn("orders_not_optimized", F.col("total_orders") - F.col("orders_matching_pallet"))
            .withColumn("optimization_rate_percent", F.col("orders_matching_pallet") / F.col("total_orders") * 100))


def order_efficiency(fact: DataFrame, window: DateWindow, pallets: DataFrame, group_by: str = "customer") -> DataFrame:
    """Per customer or product: average order size, lines per order, pallet equivalents,
    small (< 1 pallet) and optimal (whole multiple) orders, score = optimal / orders x 100."""
    o = _orders(fact, window, pallets)
    q, p = F.col("order_quantity"), F.col("pallet_quantity")
    key, names = ("customer_code", None) if group_by == "customer" else ("item_code", _lines(fact, window).groupBy(
        F.col("item_code").alias("dimension_key")).agg(F.coalesce(newest("item_description"), F.lit("")).alias("dimension_name")))
    g = o.groupBy(F.col(key).alias("dimension_key")).agg(
        F.max("customer_name").alias("dimension_name"),
        F.try_divide(M.js_sum(q), F.count(F.lit(1))).alias("avg_order_size"),
        F.try_divide(F.sum("lines"), F.countDistinct("invoice_number")).alias("avg_line_items_per_order"),
        M.fine_sum(q / p).alias("total_pallets_equivalent"),
        F.count(F.when(q < p, 1)).alias("small_orders_count"),
        F.count(F.when((q > 0) & (F.pmod(q, p) == 0), 1)).alias("optimal_orders_count"),
        F.count(F.lit(1)).alias("_orders"))
    if names is not None:
        g = g.drop("dimension_name").join(names, "dimension_key")
    return (g.withColumn("order_efficiency_score", F.col("optimal_orders_count") / F.col("_orders") * 100)
            .drop("_orders"))


def tier_performance_by_tier(fact: DataFrame, window: DateWindow, tolerance: float = 0.01) -> DataFrame:
    """Revenue, margin and distinct customers / products per matched price tier."""
    lines = _lines(fact, window).withColumn("price_tier", matched_tier(tolerance))
    g = aggregated(
        lines, [F.col("price_tier")],
        [F.count(F.lit(1)).alias("transaction_count"), M.js_sum("line_total").alias("revenue"),
         M.js_sum(_cost()).alias("_cost")],
        [M.js_distinct_count("customer_code").alias("unique_customers"),
         M.js_distinct_count("item_code").alias("unique_products")])
    return g.select("price_tier", "transaction_count", "revenue", M.margin("revenue", "_cost").alias("margin"),
                    M.margin_percent("revenue", "_cost").alias("margin_percent"), "unique_customers", "unique_products")


def orphan_status(t, fact: DataFrame | None = None) -> DataFrame:
    """Per item code seen anywhere: description, in catalogue / sales / landed costs / pallets, and the issue.

    A union of the four key sets grouped by item (no full outer joins).  Only sales lines carry a
    description; the newest line's is shown, and none for an item that was never sold."""
    def flags(df, name):
        return df.filter(F.col("item_code").isNotNull()).select("item_code").distinct().withColumn(name, F.lit(1))
    cols = ["in_catalogue", "in_sales", "in_landed_costs", "has_pallet_data"]
    parts = [flags(t.catalogue_prices, "in_catalogue"), flags(t.sales, "in_sales"), flags(t.landed_costs, "in_landed_costs"),
             flags(t.pallets, "has_pallet_data")]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    g = u.groupBy("item_code").agg(*[(F.max(F.coalesce(F.col(c), F.lit(0))) == 1).alias(c) for c in cols])
    issue = (F.when(~F.col("in_sales"), "never_sold").when(~F.col("in_catalogue"), "missing_catalogue")
             .when(~F.col("in_landed_costs"), "missing_cost").when(~F.col("has_pallet_data"), "incomplete"))
    names = t.sales.filter(F.col("item_code").isNotNull()).groupBy("item_code").agg(
        newest("item_description").alias("product_description"))
    return g.withColumn("issue_type", issue).filter(F.col("issue_type").isNotNull()).join(names, "item_code", "left").withColumn(
        "product_description", F.coalesce("product_description", F.lit("")))


def margin_contribution(fact: DataFrame, window: DateWindow) -> DataFrame:
    """Margin and revenue share of all customers, with cumulative margin % from the largest margin down."""
    per = customer_sales(fact, window, include_returns=False, include_samples=False).withColumn(
        "margin_contribution", F.col("total_revenue") - F.col("total_cost"))
    tot = per.agg(M.js_sum("margin_contribution").alias("_tm"), M.js_sum("total_revenue").alias("_tr"))
    ranked = total_order(per, "margin_contribution", ["customer_code", "customer_name"], "_rank",
                         {"_running": F.col("margin_contribution")})
    running = F.col("_running")
    return side_by_side(ranked, tot).select(
        "customer_code", "customer_name", "margin_contribution",
        (F.try_divide(F.col("margin_contribution"), F.col("_tm")) * 100).alias("margin_contribution_percent"),
        (F.try_divide(F.col("total_revenue"), F.col("_tr")) * 100).alias("revenue_contribution_percent"),
        F.try_divide(F.col("margin_contribution"), F.col("total_revenue")).alias("margin_to_revenue_ratio"),
        (F.try_divide(running, F.col("_tm")) * 100).alias("cumulative_margin_percent"))


def breakeven(fact: DataFrame, window: DateWindow, target_margin_percent: float = 20) -> DataFrame:
    """Break-even price = landed cost; target price = cost / (1 - t); increase needed if below it."""
    p = product_sales(fact, window, include_returns=False, include_samples=False).filter(
        F.col("landed_cost_euro").isNotNull() & (F.col("landed_cost_euro") > 0))
    current = M.average_price("total_revenue", "total_quantity")
    target = F.col("landed_cost_euro") / (1 - target_margin_percent / 100.0)
    inc = F.greatest(target - current, F.lit(0.0))
    return p.select("item_code", "product_description", F.col("landed_cost_euro").alias("landed_cost"),
                    current.alias("current_avg_price"),
                    M.margin_percent("total_revenue", "total_cost").alias("current_margin_percent"),
                    F.col("landed_cost_euro").alias("breakeven_price"), target.alias("target_margin_price"),
                    inc.alias("price_increase_needed"),
                    F.when(current > 0, inc / current * 100).alias("price_increase_percent"))


def waterfall(fact: DataFrame, window: DateWindow) -> DataFrame:
    """List-price gross -> returns -> rebates -> net -> discounts -> cost of goods -> margin.

    Gross values INV lines at the base catalogue price where there is one (else at the
    line total); discounts are gross minus the invoiced line totals.
    """
    lines = _lines(fact, window, returns=True, samples=False)
    inv = (F.col("document_type") == "INV") & (F.col("is_return") == 0)
    crn = F.col("document_type") == "CRN"
    base = F.col("ie_base")
    list_value = F.when(base.isNotNull() & (base > 0), F.col("quantity") * base).otherwise(F.col("line_total"))
    a = lines.agg(M.js_sum(F.when(inv, list_value)).alias("gross_revenue"),
                  M.js_sum(F.when(inv, F.col("line_total"))).alias("_invoiced"),
                  F.abs(M.js_sum(F.when(crn & (F.col("is_return") == 1), F.col("line_total")))).alias("less_returns"),
                  F.abs(M.js_sum(F.when(crn & (F.col("is_return") == 0), F.col("line_total")))).alias("less_rebates"),
                  M.js_sum(F.when(inv, _cost())).alias("less_cost_of_goods"))
    net = F.col("gross_revenue") - F.col("less_returns") - F.col("less_rebates")
    disc = F.col("gross_revenue") - F.col("_invoiced")
    after = net - disc
    return a.select("gross_revenue", "less_returns", "less_rebates", net.alias("net_revenue"), disc.alias("less_discounts"),
                    after.alias("revenue_after_discounts"), "less_cost_of_goods",
                    (after - F.col("less_cost_of_goods")).alias("gross_margin"),
                    F.when(after != 0, (after - F.col("less_cost_of_goods")) / after * 100).otherwise(F.lit(0.0))
                    .alias("gross_margin_percent"))


def price_elasticity(fact: DataFrame, window: DateWindow, item_code: str | None = None, min_lines: int = 3) -> DataFrame:
    """Slope of ln(quantity) on ln(price) over qty > 0, price > 0 lines, per item.

    |e| > 1.05 elastic, < 0.95 inelastic, else unit elastic; ``correlation`` = corr(price, qty)."""
    lines = _lines(fact, window).filter((F.col("quantity") > 0) & (F.col("unit_price") > 0))
    if item_code:
        lines = lines.filter(F.col("item_code") == item_code)
    g = lines.groupBy("item_code").agg(
        F.coalesce(newest("item_description"), F.lit("")).alias("product_description"),
        F.count(F.lit(1)).alias("_n"), M.exact_mean("unit_price").alias("avg_price"),
        M.exact_stddev_pop("unit_price").alias("price_std_dev"), M.exact_mean("quantity").alias("avg_volume"),
        M.exact_stddev_pop("quantity").alias("volume_std_dev"),
        # from whole-number moments, logarithms to the millionth, so the order of the rows does not
        # matter; a constant price or volume gives NULL
        F.try_divide(M.exact_covar_pop("unit_price", "quantity"),
                     M.exact_stddev_pop("unit_price") * M.exact_stddev_pop("quantity")).alias("correlation"),
        F.try_divide(M.exact_covar_pop(F.log("quantity"), F.log("unit_price")),
                     M.exact_covar_pop(F.log("unit_price"))).alias("estimated_elasticity"))
    e = F.abs(F.col("estimated_elasticity"))
    return (g.filter(F.col("_n") >= min_lines).drop("_n")
            .withColumn("elasticity_interpretation", F.when(e.isNull(), F.lit(None))
                        .when(e > 1.05, "elastic").when(e < 0.95, "inelastic").otherwise("unit_elastic")))


def contribution_by_segment(fact: DataFrame, window: DateWindow, customers: DataFrame,
                            segment_by: str = "customer_segment") -> DataFrame:
    """Contribution margin per segment (customer, product, buying group or region)."""
    lines = _lines(fact, window)
    if segment_by in ("customer_segment", "region"):
        col = "buying_group" if segment_by == "customer_segment" else "region"
        # one row a code, the least segment of a code that the master has twice, so no line counts twice
        seg = customers.groupBy("customer_code").agg(F.min(col).alias("segment"))
        lines = lines.join(seg, "customer_code", "left")
        key = F.coalesce(F.col("segment"), F.lit("Unassigned"))
    elif segment_by == "product":
        key = F.col("item_code")
    else:
        key = F.col("customer_code")
    g = lines.groupBy(key.alias("segment")).agg(M.js_sum("line_total").alias("revenue"),
                                                M.js_sum(_cost()).alias("variable_costs"))
    cm = F.col("revenue") - F.col("variable_costs")
    return g.select("segment", "revenue", "variable_costs", cm.alias("contribution_margin"),
                    M.margin_percent("revenue", "variable_costs").alias("contribution_margin_percent"),
                    F.when(F.col("revenue") != 0, cm / F.col("revenue")).otherwise(F.lit(0.0))
                    .alias("contribution_margin_ratio"))


def ltv_prediction(fact: DataFrame, window: DateWindow, limit: int | None = None) -> DataFrame:
    """Next-12-month revenue = revenue / age x 365 x retention (low 1, medium 0.5,
    high 0.2 churn risk); margin at the historical rate; confidence = min(1, lines / 24)."""
    items = customer_ops.lifetime_value(fact, window, limit=limit).items
    days = F.datediff(F.to_date(F.lit(window.as_of)), F.try_to_date("last_purchase_date"))
    risk = (F.when(days > 90, F.when(F.col("total_revenue") > 10000, "high").otherwise("medium")).otherwise("low"))
    factor = F.when(F.col("churn_risk") == "high", 0.2).when(F.col("churn_risk") == "medium", 0.5).otherwise(1.0)
    annual = F.col("total_revenue") / F.col("customer_age_days") * 365
    return (items.withColumn("churn_risk", risk)
            .select("customer_code", "customer_name", "total_revenue", "total_margin", "churn_risk",
                    (annual * factor).alias("predicted_12m_revenue"),
                    (annual * factor * F.try_divide(F.col("total_margin"), F.col("total_revenue")))
                    .alias("predicted_12m_margin"),
                    F.least(F.lit(1.0), F.col("total_transactions") / 24.0).alias("confidence")))


def wider_quality_report(t, sales_raw: DataFrame) -> DataFrame:
    """Nine data-quality counters as (metric, value).  Names are counted on the raw sales:
    after P16 every code has one name."""
    from .cleaning import NEGATIVE_QTY_ISSUE, to_long
    s, c = t.sales, F.col
    wide = s.agg(F.count(F.lit(1)).alias("total_sales_records"),
                 F.count("data_quality_issue").alias("records_with_dq_issues"),
                 F.count(F.when(c("data_quality_issue") == NEGATIVE_QTY_ISSUE, 1))
                 .alias("invoices_with_negative_qty_corrected"),
                 F.count(F.when(c("is_sample") == 1, 1)).alias("samples_and_promos"),
                 F.count(F.when(c("is_return") == 1, 1)).alias("returns"),
                 F.count(F.when(c("is_rebate") == 1, 1)).alias("rebates"))
    items = s.filter(c("item_code").isNotNull()).select("item_code").distinct()
    costed = t.landed_costs.filter(c("landed_cost_euro").isNotNull()).select("item_code")
    missing = [items.join(have, "item_code", "left_anti").agg(F.count(F.lit(1)).alias(name)) for have, name in (
        (costed, "products_missing_cost"), (t.catalogue_prices.select("item_code"), "products_missing_catalogue"))]
    names = (sales_raw.filter(c("customer_code").isNotNull()).groupBy("customer_code")
             .agg(F.countDistinct("customer_name").alias("_n")).filter(c("_n") > 1)
             .agg(F.count(F.lit(1)).alias("customer_name_variations")))
    out = to_long(wide)
    for one in (*missing, names):
        out = out.unionByName(to_long(one))
    return out


def dashboard_with_comparison(fact: DataFrame, window: DateWindow) -> DataFrame:
    """E1 plus revenue growth against the previous period of the same length (T4)."""
    g = growth(fact, window).summary.select(F.col("overall_growth_percent").alias("period_over_period_growth"))
    return side_by_side(executive_ops.dashboard(fact, window), g)


def discount_impact(fact: DataFrame, window: DateWindow, dim: str = "customer", min_discount: float = 0) -> DataFrame:
    """Revenue before discount, discount given and margin with / without it, per dimension."""
    a = discount_ops.discount_effectiveness(fact, window, dim=dim, min_discount=min_discount, min_lines=1, limit=None)
    return a.items.select("dimension_key", "dimension_name", F.col("revenue_with_discount").alias("total_revenue"),
                          (F.col("revenue_without_discount") - F.col("revenue_with_discount")).alias("total_discount_given"),
                          F.col("revenue_without_discount").alias("revenue_before_discount"), "avg_discount_percent",
                          "margin_without_discount", "margin_with_discount",
                          (F.col("margin_without_discount") - F.col("margin_with_discount")).alias("margin_impact"),
                          "transaction_count")


def problem_report_extra(fact: DataFrame, window: DateWindow, n: int = 10) -> Analysis:
    """High-return-rate products (G4) and slow-moving stock (D1), top ``n`` each."""
    return Analysis(discount_ops.returns(fact, window, dim="product", limit=n).items,
                    product_ops.slow_movers(fact, window, limit=n).items)
