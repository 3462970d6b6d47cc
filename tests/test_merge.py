"""Batches merged into the versioned silver layer against a full rebuild."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from pricelens.operators import cleaning, margin
from pricelens.operators.facts import DateWindow, Tables, enrich
from pricelens.sources import files, testdata
from pricelens.streaming import merge

SF = "/root/testdata/sf0.001"
WHOLE = DateWindow("1995-01-01", "2001-08-01")


def _rows(df):
    return sorted(map(str, df.collect()))


def _same(engine, sales_raw, raw):
    whole = Tables.from_raw(testdata.RawTables(sales_raw, raw.landed_costs, raw.catalogue_prices,
                                               raw.customer_product_keys, raw.pallet_sizes))
    fact = enrich(whole)
    assert _rows(engine.fact.select(*fact.columns)) == _rows(fact)
    m1 = [margin.customer_profitability(f, WHOLE, include_returns=True, limit=None) for f in (engine.fact, fact)]
    assert _rows(m1[0]) == _rows(m1[1]) and m1[1].count() > 0
    assert _rows(engine.tables.sales) == _rows(whole.sales)


@pytest.fixture(scope="module")
def raw(spark):
    return testdata.load(spark, SF)


def _renaming(spark, raw):
    """Three batches; the second gives the first's customers another most frequent name."""
    sales = raw.sales_raw
    part = F.pmod(F.xxhash64("invoice_number", "item_code"), F.lit(10))
    few = F.col("customer_code").isin([r[0] for r in sales.select("customer_code").where("customer_code is not null")
                                       .distinct().orderBy("customer_code").limit(3).collect()])
    first, rest = sales.where(part < 3), sales.where(part >= 3)
    rest = rest.withColumn("customer_name", F.when(few, F.lit("Renamed")).otherwise(F.col("customer_name")))
    third = first.limit(5).withColumn("invoice_date", F.lit(None).cast("string"))
    return [first, rest, third]


def test_batches_equal_a_full_rebuild(spark, raw):
    path = tempfile.mkdtemp()
    merge.start(Tables.from_raw(raw), path)
    assert merge.engine(spark, path).fact.count() == 0
    batches = [b.cache() for b in _renaming(spark, raw)]
    seen = None
    for n, batch in enumerate(batches, 1):
        ruled = cleaning.apply_business_rules(batch)
        assert merge.merge_sales(spark, path, ruled, n)
        assert not merge.merge_sales(spark, path, ruled, n)  # delivered again
        seen = batch if seen is None else seen.unionByName(batch)
        _same(merge.engine(spark, path), seen, raw)
    _same(merge.engine(spark, path, version=2), batches[0].unionByName(batches[1]), raw)
    assert merge.engine(spark, path).fact.where("customer_name = 'Renamed'").count() > 0


def test_an_unfinished_version_is_replaced_and_empty_batches_are_versions(spark, raw):
    path = tempfile.mkdtemp()
    merge.start(Tables.from_raw(raw), path)
    lines = cleaning.apply_business_rules(raw.sales_raw.limit(50).cache())
    assert merge.merge_sales(spark, path, lines.limit(0), 1) and merge.engine(spark, path).fact.count() == 0
    # what an attempt left that died before its manifest
    lines.limit(7).withColumn("invoice_year", F.lit("1997")).write.partitionBy("invoice_year").parquet(
        f"{path}/fact_versions/version=2")
    assert merge.engine(spark, path).fact.count() == 0
    assert merge.merge_sales(spark, path, lines, 2) and merge.engine(spark, path).fact.count() == 50
    assert merge.merge_sales(spark, path, lines.limit(0), 3) and merge.engine(spark, path).fact.count() == 50


def test_years_in_many_folders_are_put_together(spark, raw, monkeypatch):
    monkeypatch.setattr(merge, "COMPACT_AFTER", 2)
    path = tempfile.mkdtemp()
    merge.start(Tables.from_raw(raw), path)
    batch = raw.sales_raw.where("invoice_date like '1997%'").limit(10).cache()
    for n in (1, 2, 3):
        merge.merge_sales(spark, path, cleaning.apply_business_rules(batch), n)
    assert merge._manifest(spark, path)[1] == [("1997", 3)]
    _same(merge.engine(spark, path), batch.unionByName(batch).unionByName(batch), raw)


def test_streamed_files_with_quoted_line_ends(spark, raw):
    path, landing = tempfile.mkdtemp(), tempfile.mkdtemp()
    merge.start(Tables.from_raw(raw), path)
    head = ("Customer Code,Customer Name,Region,Document Number,Document Type,Document Date,Item SKU,"
            "Item Description,Item Quantity,Currency,Price\n")

    def put(name, *lines):
        with open(os.path.join(landing, name), "w", newline="") as f:
            f.write(head + "".join(line + "\n" for line in lines))

    put("a b.csv", 'C1,Acme,EU,1,INV,03/02/2001,X1,"two\nlines",2,GBP,10', ",,,,,,,,,,", "C1,Acme,EU,2,INV,3/2/2000,X1,w,1,EUR,5")
    merge.start_merging(spark, landing, path).awaitTermination(120)
    got = {r["invoice_number"]: r for r in merge.engine(spark, path).fact.collect()}
    assert set(got) == {"1", "2"} and got["1"]["item_description"] == "two\nlines" and got["1"]["unit_price"] == 11.5
    put("c.csv", *[f"C1,Zed,EU,{n},INV,03/02/1999,X1,w,1,EUR,5" for n in (3, 4, 5)])
    merge.start_merging(spark, landing, path).awaitTermination(120)
    merge.start_merging(spark, landing, path).awaitTermination(120)  # nothing new
    fact = merge.engine(spark, path).fact
    assert {r["customer_name"] for r in fact.collect()} == {"Zed"} and fact.count() == 5
    batch = files.read_sales(spark, landing)
    _same(merge.engine(spark, path), batch, raw)
