"""Cleaning pipeline P1-P19.

The rules the reference applies as eight ordered UPDATE statements are one narrow
projection here (no shuffle).  Only name standardisation (P16) needs an aggregate,
which is partially aggregated per task before any row is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the business rules.
GBP_TO_EUR = 1.15
NEAR_ZERO_PRICE = 0.1
NEGATIVE_QTY_ISSUE = "Negative quantity on invoice - converted to positive"


def _flag(cond) -> F.Column:
    # An UPDATE skips rows whose WHERE is NULL, so a NULL condition means "not set".
    return F.coalesce(cond, F.lit(False))


def apply_business_rules(raw: DataFrame) -> DataFrame:
    """P1-P12 as one projection over the raw sales rows (columns keep raw names)."""
    gbp = _flag(F.col("currency") == "GBP")
    doc = F.when(F.col("line_total") < 0, "CRN").otherwise("INV")                  # P1
    price = F.when(gbp, F.col("unit_price") * GBP_TO_EUR).otherwise(F.col("unit_price"))   # P2
    total = F.when(gbp, F.col("line_total") * GBP_TO_EUR).otherwise(F.col("line_total"))
    currency = F.when(gbp | _flag(F.col("currency") == "Eur"), "EUR").otherwise(F.col("currency"))
    return (raw.withColumns({"document_type": doc, "unit_price": price, "line_total": total,
                             "currency": currency})
               .withColumns(_rule_columns()))


def _rule_columns() -> dict:
    q, p = F.col("quantity"), F.col("unit_price")
    crn, inv = F.col("document_type") == "CRN", F.col("document_type") == "INV"
    neg_on_invoice = _flag(inv & (q < 0))                                            # P5 (P11 is dead)
    return {
        "is_rebate": _flag(crn & ((p < 0) | (q > 0))).cast("int"),                    # P4, P7
        "is_return": _flag(crn & (q < 0)).cast("int"),                                # P6
        "unit_type": F.when(_flag(inv & (q >= 0) & (q % 1 != 0)), F.lit("meter")),    # P8
        "is_sample": _flag((inv & (p > 0) & (p < NEAR_ZERO_PRICE)) | ((p == 0) & (q > 0))).cast("int"),  # P9, P10
        "data_quality_issue": F.when(neg_on_invoice, F.lit(NEGATIVE_QTY_ISSUE)),
        "quantity": F.when(neg_on_invoice, F.abs(q)).otherwise(q),                   # P5, P12
    }


def customer_name_counts(raw: DataFrame) -> DataFrame:
    """(customer_code, customer_name, cnt) for non-null codes; NULL names are candidates."""
    return (raw.filter(F.col("customer_code").isNotNull())
               .groupBy("customer_code", "customer_name").agg(F.count(F.lit(1)).alias("cnt")))


def standard_names(raw: DataFrame) -> DataFrame:
    """Most frequent name per code; tie -> smallest name, NULL name last (K3)."""
    rank_key = F.struct(-F.col("cnt"), F.col("customer_name").isNull(), F.col("customer_name"))
    return (customer_name_counts(raw).groupBy("customer_code")
            .agg(F.min_by("customer_name", rank_key).alias("standard_name")))


def name_variations(raw: DataFrame) -> DataFrame:
    """Codes with more than one name, names by count desc, chosen name, total rows."""
    counts = customer_name_counts(raw)
    ranked = F.sort_array(F.collect_list(F.struct(-F.col("cnt"), F.col("customer_name").isNull(),
                                                  F.col("customer_name").alias("name"))))
    return (counts.groupBy("customer_code")
            .agg(ranked.alias("r"), F.sum("cnt").alias("occurrences"), F.count(F.lit(1)).alias("n_names"))
            .filter(F.col("n_names") > 1)
            .select("customer_code",
                    F.transform("r", lambda x: x["name"]).alias("original_names"),
                    F.col("r")[0]["name"].alias("standardized_name"),
                    "occurrences"))


def names_by_count(raw: DataFrame) -> DataFrame:
    """Each name of the codes with more than one, with its rows, its place by rows and the chosen name.

    A row a (code, name), so a code of very many names is split like any other; names that are
    equally frequent share a place."""
    counts = customer_name_counts(raw)
    rows = counts.groupBy("customer_code", "cnt").agg(F.count(F.lit(1)).alias("_same"))
    before = W.partitionBy("customer_code").orderBy(F.col("cnt").desc()).rowsBetween(W.unboundedPreceding, -1)
    places = rows.select("customer_code", "cnt", (F.coalesce(F.sum("_same").over(before), F.lit(0)) + 1).alias("place"))
    several = counts.groupBy("customer_code").agg(F.count(F.lit(1)).alias("n_names")).filter(F.col("n_names") > 1)
    return (counts.join(several, "customer_code").join(places, ["customer_code", "cnt"])
            .join(standard_names(raw), "customer_code")
            .select("customer_code", F.col("customer_name").alias("original_name"), F.col("cnt").alias("occurrences"),
                    "place", F.col("standard_name").alias("standardized_name")))


SALES_COLUMNS = ["invoice_number", "invoice_date", "customer_code", "customer_name", "item_code",
                 "item_description", "quantity", "currency", "unit_price", "line_total", "document_type",
                 "is_rebate", "is_return", "is_sample", "unit_type", "data_quality_issue"]


def with_standard_names(lines: DataFrame, names: DataFrame) -> DataFrame:
    """``lines`` with the standard name of their code; a code without one, or none, has a null name."""
    return (lines.join(names, "customer_code", "left").withColumn("customer_name", F.col("standard_name"))
                 .drop("standard_name"))


def clean_sales(raw: DataFrame) -> DataFrame:
    """The cleaned ``sales`` table.

    The name table has one row per customer code; Spark broadcasts it when its
    measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise
    sort-merge joins it (AQE splits a hot customer's partition).  The rules come after the
    join, so that no column made by them is shuffled.
    """
    return apply_business_rules(with_standard_names(raw, standard_names(raw))).select(*SALES_COLUMNS)


def dedup_first(df: DataFrame, key: str = "item_code", order: str = "load_key") -> DataFrame:
    """Keep the first-loaded row per key; rows with a NULL key are all kept.

    ``min_by`` over a struct is a sort-based aggregate, but combined before the shuffle, so a key
    with millions of duplicates never lands whole in one task.
    """
    cols = [c for c in df.columns if c != key]
    first = (df.filter(F.col(key).isNotNull()).groupBy(key)
               .agg(F.min_by(F.struct(*cols), F.col(order)).alias("r"))
               .select(key, *[F.col("r")[c].alias(c) for c in cols]))
    return first.unionByName(df.filter(F.col(key).isNull()))


def drop_empty_pallets(pallets: DataFrame) -> DataFrame:
    """Delete pallet rows whose code is NULL or ''."""
    return pallets.filter(F.col("item_code").isNotNull() & (F.col("item_code") != ""))


def to_long(wide: DataFrame, key: str = "metric", value: str = "value", cast: str = "bigint") -> DataFrame:
    """Unpivot a one-row aggregate into (metric, value) rows."""
    return wide.unpivot([], [F.col(c).cast(cast).alias(c) for c in wide.columns], key, value)


def currency_distribution(raw: DataFrame) -> DataFrame:
    """Rows per currency before conversion (NULL currency kept as its own group)."""
    return raw.groupBy("currency").agg(F.count(F.lit(1)).alias("records"))


def non_eur_remaining(raw: DataFrame) -> DataFrame:
    """Rows still not in EUR after conversion (``currency != 'EUR' OR NULL``)."""
    c = F.col("currency")
    return apply_business_rules(raw).agg(
        F.sum(F.when(c.isNull() | (c != "EUR"), 1).otherwise(0)).cast("long").alias("non_eur_remaining"))


def _count_if(cond) -> F.Column:
    return F.sum(F.when(_flag(cond), 1).otherwise(0)).cast("long")


def _distinct_keys(c) -> F.Column:
    # Rows left after first-row dedup: one per distinct code, plus every NULL-code row.
    return (F.countDistinct(c) + F.sum(F.col(c).isNull().cast("long"))).cast("long")


def cleaning_metrics(raw: DataFrame, catalogue: DataFrame, costs: DataFrame, pallets: DataFrame,
                     customers: DataFrame) -> DataFrame:
    """Counters of the cleaning report as a long (metric, value) table.

    One aggregate pass over the sales rows plus one small aggregate per dimension;
    the single-row results are unpivoted and unioned (no joins).
    """
    r = apply_business_rules(raw.withColumns({"raw_quantity": F.col("quantity"),
                                              "raw_currency": F.col("currency")}))
    q, p, rq = F.col("quantity"), F.col("unit_price"), F.col("raw_quantity")
    crn, inv = F.col("document_type") == "CRN", F.col("document_type") == "INV"
    near_zero = inv & (p > 0) & (p < NEAR_ZERO_PRICE)
    sales = r.agg(
        F.count(F.lit(1)).alias("sales_records"),
        _count_if(inv).alias("invoices"),
        _count_if(crn).alias("credit_notes"),
        _count_if(F.col("raw_currency") == "GBP").alias("currency_converted"),
        _count_if(crn & (p < 0)).alias("price_rebates_marked"),
        _count_if(F.col("data_quality_issue").isNotNull()).alias("negative_qty_on_inv_fixed"),
        _count_if(F.col("is_return") == 1).alias("returns_marked"),
        _count_if(crn & (rq > 0)).alias("quantity_rebates_marked"),
        _count_if(F.col("unit_type") == "meter").alias("fractional_qty_marked"),
        _count_if(near_zero).alias("near_zero_samples_marked"),
        _count_if((p == 0) & (rq > 0) & ~_flag(near_zero)).alias("zero_price_samples_marked"),
    )
    code = "item_code"
    parts = [
        to_long(sales),
        to_long(catalogue.agg((F.count(F.lit(1)) - _distinct_keys(code)).alias("catalogue_duplicates_removed"),
                              _distinct_keys(code).alias("catalogue_records"))),
        to_long(costs.agg((F.count(F.lit(1)) - _distinct_keys(code)).alias("cost_duplicates_removed"),
                          _distinct_keys(code).alias("landed_cost_records"))),
        to_long(pallets.agg(_count_if(F.col(code).isNull() | (F.col(code) == "")).alias("empty_pallets_removed"),
                            _count_if(F.col(code).isNotNull() & (F.col(code) != "")).alias("pallet_records"))),
        to_long(customers.agg(F.count(F.lit(1)).alias("customer_records"))),
        to_long(standard_names(raw).agg(F.count(F.lit(1)).alias("customer_names_standardized"))),
        to_long(name_variations(raw).agg(F.count(F.lit(1)).alias("customer_name_variations"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
