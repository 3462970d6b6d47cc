"""User-facing entry point: one object holding the cleaned tables and the fact."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .operators.facts import DateWindow, SomeSales, Tables, enrich
from .sources import testdata
from .sources.sinks import Silver, read_silver


class Engine:
    """Holds the cleaned tables; every analysis is a lazy DataFrame over them."""

    def __init__(self, tables: Tables, as_of: str = "2001-08-01", raw=None, fact: DataFrame | None = None):
        """``raw`` is the raw tables or a zero-argument function producing them
        (only the cleaning reports and the raw views read them).  ``fact`` is a
        materialised enriched fact; without it the fact is the B1 join."""
        self.tables = tables
        self.as_of = as_of
        self._raw = raw if raw is not None else tables.raw
        if fact is not None:
            self.__dict__["fact"] = fact

    @property
    def raw(self) -> testdata.RawTables:
        if callable(self._raw):
            self._raw = self._raw()
        return self._raw

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str, as_of: str = "2001-08-01") -> "Engine":
        raw = testdata.load(spark, sf_dir)
        return cls(Tables.from_raw(raw), as_of, raw)

    @classmethod
    def from_silver(cls, spark: SparkSession, path: str, as_of: str = "2001-08-01", raw=None) -> "Engine":
        tables, fact = read_silver(spark, path)
        return cls(tables, as_of, raw, fact)

    @cached_property
    def fact(self) -> DataFrame:
        return self.tables.fact if isinstance(self.tables, Silver) else enrich(self.tables)

    def lines(self, *columns: str) -> DataFrame:
        """Columns of the fact, for analyses that read few of them: see ``Silver.lines``."""
        return self.tables.lines(*columns) if isinstance(self.tables, Silver) else self.fact.select(*columns)

    def with_sales(self, *columns: str) -> SomeSales:
        """The tables, with only these columns of the sales: see ``Silver.lines``."""
        return SomeSales(self.tables, self.lines(*columns))

    def window(self, start: str | None = None, end: str | None = None) -> DateWindow:
        return DateWindow(start, end, self.as_of)
