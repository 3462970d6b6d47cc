"""Cleaned tables, the enriched fact (B1) and the customer / product base queries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..sources.testdata import RawTables
from . import cleaning

WHOLE_HISTORY = ("0000-01-01", "9999-12-31")


@dataclass(frozen=True)
class Analysis:
    """An analysis answer: a one-row ``summary`` and an ``items`` table."""
    summary: DataFrame
    items: DataFrame


@dataclass
class Tables:
    """Cleaned ("silver") tables every analysis reads."""
    sales: DataFrame
    landed_costs: DataFrame
    catalogue_prices: DataFrame
    customers: DataFrame
    pallets: DataFrame
    raw: RawTables | None = field(default=None, repr=False)

    @classmethod
    def from_raw(cls, raw: RawTables) -> "Tables":
        names = ("sales", "landed_costs", "catalogue_prices", "customers", "pallets")
        return cls(**{n: cls.cleaned(n, raw) for n in names}, raw=raw)

    @staticmethod
    def cleaned(name: str, raw: RawTables) -> DataFrame:
        """One of the tables; only the raw table that it comes from is looked at."""
        if name == "sales":
            return cleaning.clean_sales(raw.sales_raw)
        if name == "customers":
            return raw.customer_product_keys
        if name == "pallets":
            return cleaning.drop_empty_pallets(raw.pallet_sizes)
        return cleaning.dedup_first(getattr(raw, name)).drop("load_key")


class SomeSales:
    """The tables of ``tables``, with ``sales`` of fewer columns; the others are asked for when they are read."""

    def __init__(self, tables: Tables, sales: DataFrame):
        self._tables, self.sales = tables, sales

    def __getattr__(self, name: str) -> DataFrame:
        return getattr(self._tables, name)


@dataclass(frozen=True)
class DateWindow:
    """Inclusive date window on the text ``invoice_date``.

    ``as_of`` replaces "now" for every now-relative rule.  When either end is
    missing the window is the 12 months up to ``as_of``.
    """
    start: str | None = None
    end: str | None = None
    as_of: str = "2001-08-01"

    def bounds(self) -> tuple[F.Column, F.Column]:
        if self.start and self.end:
            return F.lit(self.start), F.lit(self.end)
        end = F.to_date(F.lit(self.as_of))
        return F.add_months(end, -12).cast("string"), end.cast("string")

    def predicate(self, column: str = "invoice_date") -> F.Column:
        lo, hi = self.bounds()
        return F.col(column).between(lo, hi)


def newest(value: str) -> F.Column:
    """The value on a group's newest line (latest date; ties -> highest invoice
    number, then the larger non-NULL value), as an aggregate with map-side combine."""
    return F.max_by(F.col(value), F.struct(F.col("invoice_date"), F.col("invoice_number"), F.col(value)))


def enrich(t: Tables) -> DataFrame:
    """B1 without filters: sales ⟕ landed_costs ⟕ catalogue_prices on item_code.

    Both dimensions hold one row per item after dedup; Spark broadcasts them when
    their measured size is under the broadcast threshold and falls back to a
    sort-merge join otherwise.
    """
    return _with_discount(_with_prices(t.sales, t))


def enriched(named: DataFrame, t: Tables) -> DataFrame:
    """``enrich`` of the sales cleaned from ``named``, raw lines with standard names; the rules come after the joins,
    so that the raw columns only are shuffled.  Of ``t`` the costs and the catalogue are read."""
    lines = _with_prices(named, t)
    added = lines.columns[len(named.columns):]
    sales = [c for c in cleaning.SALES_COLUMNS if c != "item_code"]
    return _with_discount(cleaning.apply_business_rules(lines).select("item_code", *sales, *added))


CATALOGUE_COLUMNS = ("ie_base", "ie_trade", "ie_high", "ie_mid", "ie_low", "ie_edm", "ie_anew")


def lines_of(sales_raw: DataFrame, t: Tables, columns) -> DataFrame:
    """The named columns of ``enrich``, from the raw lines.  Names, costs and catalogue hold a row a key, so one that
    no column comes from is not joined, as that neither loses nor repeats a line.  The rules come before the joins,
    so that only the columns asked for are shuffled.  Of ``t`` the costs and the catalogue are read, if needed."""
    lines = cleaning.apply_business_rules(sales_raw)
    if "customer_name" in columns:
        lines = cleaning.with_standard_names(lines, cleaning.standard_names(sales_raw))
    if "landed_cost_euro" in columns:
        lines = lines.join(t.landed_costs.select("item_code", "landed_cost_euro"), "item_code", "left")
    discount = "discount_percent" in columns
    tiers = [c for c in CATALOGUE_COLUMNS if c in columns or (discount and c == "ie_base")]
    if tiers:
        lines = lines.join(t.catalogue_prices.select("item_code", *tiers), "item_code", "left")
    return (_with_discount(lines) if discount else lines).select(*columns)


def _with_prices(lines: DataFrame, t: Tables) -> DataFrame:
    costs = t.landed_costs.select("item_code", "landed_cost_euro")
    cat = t.catalogue_prices.select("item_code", *CATALOGUE_COLUMNS)
    return lines.join(costs, "item_code", "left").join(cat, "item_code", "left")


def _with_discount(lines: DataFrame) -> DataFrame:
    q, base = F.col("quantity"), F.col("ie_base")
    discount = (F.when(base.isNotNull() & (base > 0) & (q != 0),
                       F.try_divide(q * base - F.col("line_total"), q * base) * 100)
                 .otherwise(F.lit(0.0)))
    return lines.withColumn("discount_percent", discount)


def line_cost(fact_df: DataFrame | None = None) -> F.Column:
    """Cost of a line: quantity x landed cost, missing cost as 0."""
    return F.col("quantity") * F.coalesce(F.col("landed_cost_euro"), F.lit(0.0))


LINE_COLUMNS = ("invoice_date", "document_type", "is_sample", "is_return")  # what ``base_filter`` reads


def base_filter(fact: DataFrame, window: DateWindow, include_returns: bool = True, include_samples: bool = True,
                document_types=("INV", "CRN")) -> DataFrame:
    df = fact.filter(F.col("document_type").isin(*document_types)).filter(window.predicate())
    if "invoice_year" in fact.columns:  # the silver layer's folders: read only the window's years
        lo, hi = window.bounds()
        df = df.filter(F.col("invoice_year").cast("string").between(F.substring(lo, 1, 4), F.substring(hi, 1, 4)))
    if not include_samples:
        df = df.filter(F.col("is_sample") == 0)
    if not include_returns:
        df = df.filter(F.col("is_return") == 0)
    return df


TRANSACTION_COLUMNS = ["invoice_number", "invoice_date", "customer_code", "customer_name", "item_code",
                       "quantity", "unit_price", "line_total", "discount_percent", "document_type",
                       "is_sample", "is_return", "landed_cost_euro"]


def sales_transactions(fact: DataFrame, window: DateWindow, include_returns: bool = True,
                       include_samples: bool = True, document_types=("INV", "CRN"),
                       customer_code: str | None = None, customer_codes=None,
                       item_code: str | None = None, item_codes=None,
                       min_discount: float | None = None, max_discount: float | None = None,
                       limit: int | None = None) -> DataFrame:
    """B1 ``getSalesTransactions``: filtered lines, newest first."""
    df = base_filter(fact, window, include_returns, include_samples, document_types)
    if customer_code:
        df = df.filter(F.col("customer_code") == customer_code)
    elif customer_codes:
        df = df.filter(F.col("customer_code").isin(*customer_codes))
    if item_code:
        df = df.filter(F.col("item_code") == item_code)
    elif item_codes:
        df = df.filter(F.col("item_code").isin(*item_codes))
    df = M.filter_discount_range(df, min_discount, max_discount)
    out = df.select(*TRANSACTION_COLUMNS, F.col("ie_base").alias("catalogue_price_base"),
                    F.col("ie_trade").alias("catalogue_price_trade"),
                    F.col("item_description").alias("product_description"))
    if not limit:  # all matching lines: a set; sorting every line of the window is the caller's choice
        return out
    return out.orderBy(F.col("invoice_date").desc_nulls_last(), F.col("invoice_number").asc_nulls_last(),
                       F.col("item_code").asc_nulls_last(), F.col("line_total").asc_nulls_last()).limit(limit)


_SORT_COLUMNS = {"revenue": "total_revenue", "cost": "total_cost", "quantity": "total_quantity",
                 "transactions": "transaction_count"}


def _having(df: DataFrame, min_revenue=None, max_revenue=None, min_quantity=None, min_transactions=None):
    if min_revenue is not None:
        df = df.filter(F.col("total_revenue") >= min_revenue)
    if max_revenue is not None:
        df = df.filter(F.col("total_revenue") <= max_revenue)
    if min_quantity is not None:
        df = df.filter(F.col("total_quantity") >= min_quantity)
    if min_transactions is not None:
        df = df.filter(F.col("transaction_count") >= min_transactions)
    return df


def customer_sales(fact: DataFrame, window: DateWindow, include_returns: bool = True, include_samples: bool = True,
                   customer_codes=None, min_revenue=None, max_revenue=None, min_transactions=None,
                   sort_by: str | None = None, sort_order: str = "desc", limit: int | None = None) -> DataFrame:
    """B2 ``getCustomerSales``: one row per (customer_code, customer_name)."""
    df = base_filter(fact, window, include_returns, include_samples).filter(F.col("customer_code").isNotNull())
    if customer_codes:
        df = df.filter(F.col("customer_code").isin(*customer_codes))
    out = df.groupBy("customer_code", "customer_name").agg(
        M.money_sum("quantity").alias("total_quantity"),
        M.money_sum("line_total").alias("total_revenue"),
        M.money_sum(line_cost()).alias("total_cost"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.countDistinct("item_code").alias("unique_products"))
    out = _having(out, min_revenue, max_revenue, None, min_transactions)
    if sort_by:
        out = M.top(out, _SORT_COLUMNS[sort_by], sort_order, limit, "customer_code", "customer_name")
    elif limit:
        out = out.limit(limit)
    return out


def product_sales(fact: DataFrame, window: DateWindow, include_returns: bool = True, include_samples: bool = True,
                  item_codes=None, min_revenue=None, max_revenue=None, min_quantity=None, min_transactions=None,
                  sort_by: str | None = None, sort_order: str = "desc", limit: int | None = None,
                  price_tier: str | None = None) -> DataFrame:
    """B3 ``getProductSales``: one row per item (NULL item group kept).

    ``price_tier`` (e.g. ``ie_base``) adds that catalogue column as ``catalogue_price``.
    """
    df = base_filter(fact, window, include_returns, include_samples)
    if item_codes:
        df = df.filter(F.col("item_code").isin(*item_codes))
    keys = ["item_code", "landed_cost_euro", F.col("ie_trade").alias("catalogue_price_trade")]
    if price_tier:
        keys.append(F.col(price_tier).alias("catalogue_price"))
    # Numeric aggregates keep fixed-width buffers (hash aggregation with map-side
    # combine); the text MAX(description) would force a sort-based aggregate over
    # every line, so it is taken over the distinct (item, description) pairs instead.
    numeric = df.groupBy(*keys).agg(
        M.money_sum("quantity").alias("total_quantity"),
        M.money_sum("line_total").alias("total_revenue"),
        M.money_sum(line_cost()).alias("total_cost"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.countDistinct("customer_code").alias("unique_customers"))
    desc = (df.select(F.col("item_code").alias("_item"), "item_description").distinct()
            .groupBy("_item").agg(F.max("item_description").alias("_desc")))
    out = (numeric.join(desc, F.col("item_code").eqNullSafe(F.col("_item")), "left")
           .withColumn("product_description", F.coalesce(F.col("_desc"), F.lit("Unknown")))
           .drop("_item", "_desc"))
    out = _having(out, min_revenue, max_revenue, min_quantity, min_transactions)
    if sort_by:
        out = M.top(out, _SORT_COLUMNS[sort_by], sort_order, limit, "item_code")
    elif limit:
        out = out.limit(limit)
    return out
