"""Property checks on the fixture engine."""

from pyspark.sql import functions as F

from pricelens.functions import metrics as M
from pricelens.operators import customer, facts, product
from pricelens.plans import registry

SF = "/root/testdata/sf0.001"


def _engine(spark):
    return registry.engine_for(spark, SF)


def test_document_types_partition_all_lines(spark):
    s = _engine(spark).tables.sales
    n = s.count()
    assert s.filter(F.col("document_type").isin("INV", "CRN")).count() == n


def test_group_revenue_sums_to_total(spark):
    e = _engine(spark)
    total = e.fact.agg(M.js_sum("line_total")).collect()[0][0]
    by_product = facts.product_sales(e.fact, registry.WHOLE).agg(M.js_sum("total_revenue")).collect()[0][0]
    assert abs(total - by_product) < 1e-6


def test_abc_running_share_ends_at_100(spark):
    e = _engine(spark)
    mix = product.product_mix(e.fact, registry.WHOLE, limit=10_000).items
    last = mix.orderBy(F.col("cumulative_revenue_percent").desc()).first()["cumulative_revenue_percent"]
    assert abs(last - 100) < 1e-9


def test_pairs_are_ordered_and_unique(spark):
    e = _engine(spark)
    pairs = product.cross_sell(e.fact, registry.WHOLE, min_co_occurrence=1, limit=None).items
    assert pairs.filter(F.col("product_a_code") >= F.col("product_b_code")).count() == 0
    assert pairs.count() == pairs.select("product_a_code", "product_b_code").distinct().count()
    total = product.cross_sell_total_pairs(e.fact, registry.WHOLE).collect()[0][0]
    assert total == pairs.count()  # with support 1 nothing is pruned


def test_segments_cover_population(spark):
    e = _engine(spark)
    s = customer.segmentation(e.fact, registry.WHOLE).summary.collect()[0]
    assert s["high_value_count"] + s["medium_value_count"] + s["low_value_count"] == s["total_customers"]


def test_paginate(spark):
    df = spark.range(25).orderBy("id")
    assert [r[0] for r in M.paginate(df, 3, 10).collect()] == list(range(20, 25))


def test_silver_round_trip(spark, tmp_path):
    from pricelens.sources import sinks, testdata
    t = facts.Tables.from_raw(testdata.load(spark, SF))
    path = str(tmp_path / "silver")
    sinks.write_silver(t, path)
    back, fact = sinks.read_silver(spark, path)
    assert back.sales.count() == t.sales.count() == fact.count()
    assert sorted(back.sales.columns) == sorted(t.sales.columns)
