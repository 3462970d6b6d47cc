"""Persist the raw tables ("bronze") and the cleaned ones ("silver") as Parquet and read them back."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import SALES_COLUMNS, standard_names, with_standard_names
from ..operators.facts import Tables, enrich, enriched, lines_of
from .testdata import RawTables

RAW_TABLES = ("sales_raw", "landed_costs", "catalogue_prices", "customer_product_keys", "pallet_sizes")
TABLES = ("sales", "landed_costs", "catalogue_prices", "customers", "pallets")


def _write(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_bronze(raw: RawTables, path: str, mode: str = "overwrite") -> None:
    """Persist the imported, not yet cleaned tables (the raw database of the reference)."""
    for name in RAW_TABLES:
        _write(getattr(raw, name), f"{path}/{name}", mode)


def read_bronze(spark: SparkSession, path: str) -> RawTables:
    return RawTables(**{n: spark.read.parquet(f"{path}/{n}") for n in RAW_TABLES})


def write_silver(t: Tables, path: str, mode: str = "overwrite") -> None:
    """Write every cleaned table under ``path``.

    Sales are written once, already joined with their dimensions, which hold a row an item: every analysis
    reads this enriched fact, so the join runs once per load, not per query, and the sales table is its first columns.
    ``overwrite`` replaces a table atomically per job commit.
    """
    for name in TABLES[1:]:
        _write(getattr(t, name), f"{path}/{name}", mode)
    spark = t.sales.sparkSession
    _write_fact(enrich(Tables(sales=t.sales, **{n: spark.read.parquet(f"{path}/{n}") for n in TABLES[1:]})), path, mode)


def _write_fact(fact: DataFrame, path: str, mode: str = "overwrite") -> None:
    # Partitioned by invoice year, so date windows prune whole folders; sorted by date for row-group skipping.
    # The tasks of the last join write the years they hold (AQE merges small tasks and splits a hot item's): a shuffle
    # by year before would move the widest rows of the load once more.
    (fact.withColumn("invoice_year", F.substring("invoice_date", 1, 4))
     .sortWithinPartitions("invoice_year", "invoice_date")
     .write.mode(mode).option("compression", "zstd").partitionBy("invoice_year").parquet(f"{path}/fact"))


def _sales(fact: DataFrame) -> DataFrame:
    return fact.select(*SALES_COLUMNS)


def read_silver(spark: SparkSession, path: str) -> tuple[Tables, DataFrame]:
    """The cleaned tables and the enriched fact written by ``write_silver``."""
    fact = spark.read.parquet(f"{path}/fact")  # keeps invoice_year: date windows prune its folders
    return Tables(sales=_sales(fact), **{n: spark.read.parquet(f"{path}/{n}") for n in TABLES[1:]}), fact


class _Written:
    """Tables as attributes, each written under ``path`` when it is first asked for, and read back."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path, self._lock = spark, path, threading.RLock()

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        with self._lock:
            if name not in self.__dict__:
                self.__dict__[name] = self._made(name)
            return self.__dict__[name]

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        _write(df, f"{self._path}/{name}", "overwrite")
        return self._spark.read.parquet(f"{self._path}/{name}")


class Bronze(_Written):
    """The tables of ``RawTables``."""

    def __init__(self, source: RawTables, spark: SparkSession, path: str):
        super().__init__(spark, path)
        self._source = source

    def _made(self, name: str) -> DataFrame:
        if name not in RAW_TABLES:
            raise AttributeError(name)
        return self._kept(getattr(self._source, name), name)


class Silver(_Written):
    """The tables of ``Tables`` and the enriched ``fact``, cleaned from the bronze tables that each of them needs."""

    def __init__(self, raw: Bronze, spark: SparkSession, path: str):
        super().__init__(spark, path)
        self.raw = raw

    def lines(self, *columns: str) -> DataFrame:
        """Columns of the fact.  Asking for few of them does not write it: while it is not there, they come from the
        bronze lines, joined with the tables of these columns only."""
        with self._lock:
            written = "fact" in self.__dict__
        if written:
            return self.fact.select(*columns, "invoice_year")
        return lines_of(self.raw.sales_raw, self, columns)

    def _made(self, name: str) -> DataFrame:
        if name == "sales":
            return _sales(self.fact)
        if name == "fact":
            sales = self.raw.sales_raw
            _write_fact(enriched(with_standard_names(sales, standard_names(sales)), self), self._path)
            return self._spark.read.parquet(f"{self._path}/fact")
        if name not in TABLES:
            raise AttributeError(name)
        return self._kept(Tables.cleaned(name, self.raw), name)
