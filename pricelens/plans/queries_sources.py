"""Registered queries of the imports (S1-S8): the raw tables are exported once as the source's CSV
files, and every query imports them again.  Descriptions of Asian lines hold line ends there."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import functions as F

from ..session import shared_checkpoint_dir
from ..operators import cleaning, margin
from ..sources import files, schemas
from ..streaming import merge
from .oracle_base import with_base
from .queries_core import _q, b2, m1
from .registry import WHOLE, register

_EXPORTS: WeakKeyDictionary = WeakKeyDictionary()
_FILES = {"sales": schemas.SALES_HEADERS, "landed_costs": schemas.LANDED_COST_HEADERS, "catalogue_prices": schemas.CATALOGUE_HEADERS,
          "customer_product_keys": schemas.CUSTOMER_HEADERS, "pallet_sizes": schemas.PALLET_HEADERS}


def _folder(e, kind: str) -> str:
    return f"{shared_checkpoint_dir(_spark(e)).rstrip('/')}/pricelens-{kind}/{uuid.uuid4().hex}"


def _spark(e):
    return e.raw.pallet_sizes.sparkSession


def _exported(e, name: str) -> str:
    """The folder with the files of one table, written when an import first reads it."""
    paths = _EXPORTS.setdefault(e, {})
    if name not in paths:
        path = _folder(e, "export")
        if name == "sales":
            asian = F.coalesce(F.col("region") == "ASIA", F.lit(False))
            broken = F.replace("item_description", F.lit(" "), F.lit("\n"))
            for part in (e.raw.sales_raw.filter(~asian), e.raw.sales_raw.filter(asian).withColumn("item_description", broken)):
                files.write_export(part, _FILES[name], path, dates=("invoice_date",))
        else:
            files.write_export(getattr(e.raw, name), _FILES[name], path)
        paths[name] = path
    return paths[name]


_READERS = {"sales": files.read_sales, "landed_costs": files.read_landed_costs, "catalogue_prices": files.read_catalogue,
            "customer_product_keys": files.read_customers, "pallet_sizes": files.read_pallets}


def _imported(e, name: str):
    return _READERS[name](_spark(e), _exported(e, name)).drop("load_key")


_SALES = ", ".join(f.name for f in schemas.SALES_RAW.fields)
_TABLES = {
    "sales": f"SELECT * REPLACE (CASE WHEN region = 'ASIA' THEN replace(item_description, ' ', chr(10)) ELSE item_description END "
             f"AS item_description) FROM (SELECT {_SALES} FROM sales_raw2)",
    "landed_costs": "SELECT item_code, landed_cost_euro, plus_5_percent FROM landed_costs_raw2",
    "catalogue_prices": "SELECT item_code, ie_trade, ie_high, ie_mid, ie_low, ie_base, ie_edm, ie_anew FROM catalogue_raw",
    "customer_product_keys": "SELECT * FROM customer_product_keys",
    "pallet_sizes": "SELECT * FROM pallet_raw WHERE item_code <> ''",
}


@register("s2_catalogue_import", with_base("\n" + _TABLES["catalogue_prices"]))
def s2_catalogue_import(e):
    return _imported(e, "catalogue_prices")


@register("s3_landed_cost_import", with_base("\n" + _TABLES["landed_costs"]))
def s3_landed_cost_import(e):
    return _imported(e, "landed_costs")


@register("s4_sales_import", with_base("\n" + _TABLES["sales"]))
def s4_sales_import(e):
    return _imported(e, "sales")


@register("s5_customer_import", with_base("\n" + _TABLES["customer_product_keys"]))
def s5_customer_import(e):
    return _imported(e, "customer_product_keys")


@register("s6_pallet_import", with_base("\n" + _TABLES["pallet_sizes"]))
def s6_pallet_import(e):
    return _imported(e, "pallet_sizes")


@register("s7_reset_then_append", with_base("""
SELECT item_code, 2 * count(*) AS row_count, round(2 * sum(CAST(landed_cost_euro AS DECIMAL(18,2))), 2)::DOUBLE AS cost
FROM landed_costs_raw2 GROUP BY item_code"""))
def s7_reset_then_append(e):
    costs, path = _imported(e, "landed_costs"), _folder(e, "table")
    for reset in (False, True, False):  # the second load replaces the first one
        files.write_table(costs, path, reset=reset)
    return _spark(e).read.parquet(path).groupBy("item_code").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.col("landed_cost_euro").cast("decimal(18,2)")).cast("double").alias("cost"))


@register("s8_import_summary", with_base("\n" + " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS row_count FROM ({sql})" for name, sql in _TABLES.items())))
def s8_import_summary(e):
    return files.import_summary({name: _imported(e, name) for name in _FILES})


@register("s9_margin_of_merged_batches", _q(b2("b", returns=False, samples=False), m1("m", "b"), select="SELECT * FROM m"))
def s9_margin_of_merged_batches(e):
    """M1 over all customers of a layer that got its sales in two batches, which cut every customer's lines."""
    spark, path = _spark(e), _folder(e, "merged")
    merge.start(e.tables, path)
    second = F.pmod(F.xxhash64("invoice_number", "item_code"), F.lit(3)) == 0
    for version, batch in enumerate((e.raw.sales_raw.where(~second), e.raw.sales_raw.where(second)), 1):
        merge.merge_sales(spark, path, cleaning.apply_business_rules(batch), version)
    return margin.customer_profitability(merge.engine(spark, path).fact, WHOLE, limit=None)
