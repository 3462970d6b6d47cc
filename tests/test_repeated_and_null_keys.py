"""Rows that the fixture tables lack: a customer code twice in the master, lines without an item."""

from pricelens.operators import extended, quality
from pricelens.operators.facts import DateWindow

W = DateWindow("2000-01-01", "2000-12-31")
COLUMNS = ("invoice_number string, invoice_date string, customer_code string, customer_name string, item_code string, "
           "item_description string, quantity double, unit_price double, line_total double, discount_percent double, "
           "document_type string, is_sample int, is_return int, is_rebate int, landed_cost_euro double, ie_trade double, ie_base double")


def lines(spark, rows):
    return spark.createDataFrame([(str(i), "2000-02-02", c, c, item, "d", 1.0, p, p, 0.0, "INV", 0, 0, 0, 0.5, 1.0, 1.0)
                                  for i, (c, item, p) in enumerate(rows)], COLUMNS)


def test_a_code_twice_in_the_master_counts_its_lines_once(spark):
    master = spark.createDataFrame([("A", "Z group", "R"), ("A", "B group", "R"), (None, "X", "R")],
                                   "customer_code string, buying_group string, region string")
    got = extended.contribution_by_segment(lines(spark, [("A", "I", 10.0), (None, "I", 1.0)]), W, master).collect()
    assert {r["segment"]: r["revenue"] for r in got} == {"B group": 10.0, "Unassigned": 1.0}


def test_lines_without_an_item_are_a_group_of_the_anomalies(spark):
    fact = lines(spark, [("A", None, 1.0 + i % 2 / 10) for i in range(40)] + [("A", None, 500.0)])
    got = quality.anomalies(fact, W).items.collect()
    assert [(r["item_code"], r["anomaly_type"], r["actual_value"]) for r in got] == [(None, "unusual_price", 500.0)]


def test_growth_reads_the_years_of_its_windows(spark):
    from pricelens.operators import trends
    from pricelens.plans.registry import engine_for
    from .test_plans import plan
    fact = engine_for(spark, "/root/testdata/sf0.001").fact
    p = plan(trends.growth(fact, DateWindow("1998-01-01", "1998-12-31")).items)
    filters = [x for x in p.splitlines() if x.startswith("PartitionFilters")]
    assert filters and all("1998" in x and "1997" in x and "9999" not in x for x in filters)


def test_catalogue_items_that_never_sold(spark):
    from types import SimpleNamespace
    from pricelens.operators import audit
    catalogue = spark.createDataFrame([("A", 1.0), ("B", 2.0), (None, 3.0)], "item_code string, ie_trade double").selectExpr(
        "*", "ie_trade AS ie_high", "ie_trade AS ie_mid", "ie_trade AS ie_low")
    sales = spark.createDataFrame([("A",), ("A",), (None,), ("a",)], "item_code string")
    t = SimpleNamespace(catalogue_prices=catalogue, sales=sales)
    assert sorted((r["item_code"], r["ie_trade"]) for r in audit.catalogue_never_sold(t).collect() if r["item_code"]) == [("B", 2.0)]
    assert audit.catalogue_never_sold(t).count() == 2  # a price without a code matches no sale
    assert [r["item_code"] for r in audit.catalogue_never_sold(t, 1).collect()] == [None]


def test_names_of_a_code_by_count(spark):
    from pricelens.operators import cleaning
    rows = [("C", "x")] * 3 + [("C", "y")] * 3 + [("C", None)] * 5 + [("D", "z")] * 2 + [(None, "n"), (None, "m")]
    got = cleaning.names_by_count(spark.createDataFrame(rows, "customer_code string, customer_name string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [("C", None, 5, 1, None), ("C", "x", 3, 2, None), ("C", "y", 3, 2, None)], key=str)
