"""Adapter: derive the pricing tables from the driver's TPC-H-shaped Parquet tables.

The same expressions appear as SQL in ``pricelens.plans.oracle.ADAPTER_SQL`` so the
DuckDB oracle sees identical inputs.  Every table is a lazy projection / join of the
Parquet scans, so the derived data grows with the scale factor.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture rule (see FIXTURES.md section 3).
BUCKETS = 40
CATALOGUE_FACTORS = {"ie_trade": 300.0, "ie_high": 280.0, "ie_mid": 260.0, "ie_low": 240.0,
                     "ie_base": 220.0, "ie_edm": 200.0, "ie_anew": 180.0}
COST_FACTOR = 120.0
DUPLICATE_STEP = 0.05


@dataclass(frozen=True)
class RawTables:
    sales_raw: DataFrame
    landed_costs: DataFrame
    catalogue_prices: DataFrame
    customer_product_keys: DataFrame
    pallet_sizes: DataFrame


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _item(partkey) -> F.Column:
    return F.concat(F.lit("IEZ"), partkey.cast("string"))


def _copies(part: DataFrame) -> DataFrame:
    """Parts with partkey % 20 = 1 appear twice (copy 0, copy 1 priced 0.05 higher)."""
    copies = F.when(F.col("p_partkey") % 20 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (part.withColumn("copy", F.explode(copies))
                .withColumn("load_key", F.col("p_partkey") * 2 + F.col("copy")))


def sales_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The lines are shuffled twice, by part while they are narrow and by order; the orders get their customers first.
    b = (F.col("l_orderkey") + F.col("l_linenumber")) % BUCKETS
    q = F.col("l_quantity")
    px = F.floor(F.try_divide(F.col("l_extendedprice") * (1 - F.col("l_discount")), q) * 100.0) / 100.0
    quantity = (F.when(b.isin(0, 1, 2, 7), -q).when(b == 6, q + 0.5)
                 .when(b == 8, F.lit(None).cast("double")).otherwise(q))
    unit_price = (F.when(b.isin(3, 7), -px).when(b == 4, F.lit(0.0))
                   .when(b == 5, F.lit(0.05)).otherwise(px))
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", quantity.alias("quantity"), unit_price.alias("unit_price"))
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("o_orderdate"))
    # nation (25 rows) and region (5 rows) are fixed-size: broadcasting them is safe at any scale.
    geo = (_read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
           .join(F.broadcast(_read(spark, sf_dir, "region").select("r_regionkey", "r_name")),
                 F.col("n_regionkey") == F.col("r_regionkey")))
    cust = (_read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
            .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "r_name"))
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name")

    placed = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    j = (li.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
           .join(placed, F.col("l_orderkey") == F.col("o_orderkey")))
    return j.select(
        F.when(b == 9, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("customer_code"),
        F.when(F.col("l_linenumber") == 7, F.upper("c_name")).otherwise(F.col("c_name")).alias("customer_name"),
        F.col("r_name").alias("region"),
        F.col("l_orderkey").cast("string").alias("invoice_number"),
        F.lit(None).cast("string").alias("document_type"),
        F.col("o_orderdate").cast("string").alias("invoice_date"),
        F.when(b == 10, F.concat(_item(F.col("l_partkey")), F.lit(" ")))
         .otherwise(_item(F.col("l_partkey"))).alias("item_code"),
        F.when(b == 11, F.lit(None).cast("string")).otherwise(F.col("p_name")).alias("item_description"),
        "quantity",
        F.when(F.col("r_name") == "EUROPE", "GBP").when(F.col("r_name") == "ASIA", "Eur")
         .otherwise("EUR").alias("currency"),
        "unit_price",
    ).withColumn("line_total", F.col("quantity") * F.col("unit_price"))


def landed_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_retailprice").filter(F.col("p_partkey") % 15 != 0)
    base = F.when(F.col("p_partkey") % 97 == 0, F.lit(None).cast("double")).otherwise(
        F.floor(F.col("p_retailprice") * COST_FACTOR) / 100.0)
    cost = base + F.col("copy") * DUPLICATE_STEP
    return _copies(part).select("load_key", _item(F.col("p_partkey")).alias("item_code"),
                                cost.alias("landed_cost_euro"), (cost * 1.05).alias("plus_5_percent"))


def catalogue_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_retailprice").filter(F.col("p_partkey") % 4 != 0)
    tiers = [(F.floor(F.col("p_retailprice") * k) / 100.0 + F.col("copy") * DUPLICATE_STEP).alias(name)
             for name, k in CATALOGUE_FACTORS.items()]
    return _copies(part).select("load_key", _item(F.col("p_partkey")).alias("item_code"), *tiers)


def customer_product_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    geo = (_read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"),
                                               F.col("n_regionkey") == F.col("r_regionkey")))
    return (_read(spark, sf_dir, "customer").filter(F.col("c_custkey") % 50 != 0)
            .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("customer_code"),
                    F.col("c_name").alias("customer_name"),
                    F.col("c_mktsegment").alias("buying_group"),
                    F.col("r_name").alias("region"),
                    F.concat(F.lit("AM"), F.col("c_nationkey").cast("string")).alias("account_manager")))


def pallet_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").select("p_partkey")
    sized = part.filter(F.col("p_partkey") % 10 == 0).select(
        _item(F.col("p_partkey")).alias("item_code"), F.lit(40).cast("long").alias("pallet_quantity"),
        F.lit(10).cast("long").alias("carton_quantity"), F.lit(1).cast("long").alias("single_quantity"))
    # One workbook row with a blank code, which the cleaning step must drop.
    blank = part.limit(1).select(F.lit("").alias("item_code"), *[F.lit(None).cast("long").alias(c) for c in
                                                                  ("pallet_quantity", "carton_quantity", "single_quantity")])
    return sized.unionByName(blank)


def load(spark: SparkSession, sf_dir: str) -> RawTables:
    return RawTables(sales_raw(spark, sf_dir), landed_costs(spark, sf_dir), catalogue_prices(spark, sf_dir),
                     customer_product_keys(spark, sf_dir), pallet_sizes(spark, sf_dir))
