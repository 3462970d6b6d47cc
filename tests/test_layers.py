"""The bronze and silver layers: tables are written when they are asked for, and lines once."""

import os

from pricelens.engine import Engine
from pricelens.operators.facts import Tables, enrich
from pricelens.plans import queries_sources as S
from pricelens.sources import testdata
from pricelens.sources.sinks import Bronze, Silver

SF = "/root/testdata/sf0.001"


def _silver(spark, path):
    return Silver(Bronze(testdata.load(spark, SF), spark, f"{path}/bronze"), spark, path)


def _folders(path):
    return sorted(os.listdir(path)) if os.path.exists(path) else []


def test_a_table_is_written_when_asked_for_and_alone(spark, tmp_path):
    path = str(tmp_path / "layer")
    silver = _silver(spark, path)
    assert silver.pallets.count() == silver.pallets.where("item_code <> ''").count() > 0
    assert _folders(path) == ["bronze", "pallets"] and _folders(f"{path}/bronze") == ["pallet_sizes"]
    assert silver.pallets is silver.pallets


def test_sales_are_the_lines_of_the_fact(spark, tmp_path):
    path = str(tmp_path / "layer")
    silver, want = _silver(spark, path), Tables.from_raw(testdata.load(spark, SF))
    got, sales = silver.sales, want.sales
    assert got.columns == sales.columns and got.dtypes == sales.dtypes
    assert got.count() == sales.count() and not got.exceptAll(sales).count()
    assert _folders(path) == ["bronze", "catalogue_prices", "fact", "landed_costs"]  # the lines are in one table
    fact = enrich(want)
    assert silver.fact.drop("invoice_year").columns == fact.columns and not silver.fact.drop("invoice_year").exceptAll(fact).count()
    years = {f.split("=")[1] for f in _folders(f"{path}/fact") if "=" in f}
    assert years == {r[0] for r in sales.selectExpr("substr(invoice_date, 1, 4)").distinct().collect()}


def test_an_import_exports_its_own_table_only(spark, tmp_path):
    path = str(tmp_path / "layer")
    e = Engine(_silver(spark, path))
    assert S.s5_customer_import(e).count() == e.raw.customer_product_keys.count() > 0
    assert set(S._EXPORTS[e]) == {"customer_product_keys"}
    assert "sales_raw" not in _folders(f"{path}/bronze")
    assert S.s4_sales_import(e).exceptAll(S.s4_sales_import(e)).isEmpty()
    assert set(S._EXPORTS[e]) == {"customer_product_keys", "sales"}


def test_columns_of_the_fact_join_their_own_tables_only(spark, tmp_path):
    path = str(tmp_path / "layer")
    silver, want = _silver(spark, path), enrich(Tables.from_raw(testdata.load(spark, SF)))
    asked = {("invoice_number", "quantity", "data_quality_issue"): [], ("customer_code", "customer_name"): [],
             ("line_total", "landed_cost_euro"): ["landed_costs"], ("item_code", "ie_trade", "discount_percent"): ["catalogue_prices"],
             tuple(want.columns): []}
    made = {"bronze"}
    for columns, tables in asked.items():
        got, lines = silver.lines(*columns), want.select(*columns)
        made |= set(tables)
        assert got.dtypes == lines.dtypes and got.count() == lines.count() and not got.exceptAll(lines).count()
        assert set(_folders(path)) == made  # no fact, and no table that the columns do not come from
    assert silver.fact and silver.lines("quantity").columns == ["quantity", "invoice_year"]


def _without_the_fact(spark, path, *names):
    """The results of queries that come first, and again once the fact is written."""
    from pricelens.plans.registry import QUERIES, spark_queries
    spark_queries()
    e = Engine(_silver(spark, path))
    first = {n: sorted(map(str, QUERIES[n].build(e).collect())) for n in names}
    assert "fact" not in _folders(path)
    assert e.fact and first == {n: sorted(map(str, QUERIES[n].build(e).collect())) for n in names}
    return first


def test_catalogue_compliance_does_not_write_the_fact(spark, tmp_path):
    assert all(_without_the_fact(spark, str(tmp_path), "r3_catalogue_compliance", "r3_catalogue_compliance_summary").values())


def test_lines_with_issues_do_not_write_the_fact(spark, tmp_path):
    found = _without_the_fact(spark, str(tmp_path), "a28_quality_issue_lines", "a27_metre_sales")
    assert all(found.values()) and _folders(str(tmp_path)) == ["bronze", "catalogue_prices", "fact", "landed_costs"]


def test_codes_and_orphans_of_the_sales_do_not_write_the_fact(spark, tmp_path):
    _without_the_fact(spark, str(tmp_path), "a3_top_selling_products", "a6_stats_by_month", "a9_orphan_item_count", "a9_orphan_item_sample",
                      "a10_orphan_customer_codes", "a11_date_validation", "a18_orphan_summary", "a20_orphan_negative_revenue",
                      "a22_orphans_by_month", "a23_catalogue_never_sold", "a24_invoice_orphan_breakdown", "a32_month_over_month")


def test_margin_trend_does_not_write_the_fact(spark, tmp_path):
    assert all(_without_the_fact(spark, str(tmp_path), "t6_margin_trend", "t6_margin_trend_summary", "t6_margin_trend_with_returns").values())


def test_discount_effectiveness_does_not_write_the_fact(spark, tmp_path):
    assert all(_without_the_fact(spark, str(tmp_path), "g2_discount_effectiveness", "g2_discount_effectiveness_summary",
                                  "g2_discount_effectiveness_by_product", "g2_discount_effectiveness_by_month",
                                  "g2_discount_effectiveness_by_overall").values())


def test_other_queries_of_few_columns_do_not_write_the_fact(spark, tmp_path):
    _without_the_fact(spark, str(tmp_path), "r2_price_consistency", "r2_price_consistency_summary", "t3_seasonality", "t3_seasonality_summary",
                      "t5_forecast", "t5_forecast_summary", "t5_forecast_with_returns", "g1_derived_catalogue_prices", "g4_returns",
                      "g4_returns_summary", "g4_returns_by_month", "g6_credit_notes", "t3_seasonality_by_quarter")


def test_pairs_of_items_do_not_write_the_fact(spark, tmp_path):
    _without_the_fact(spark, str(tmp_path), "x10_cross_sell_lift")


def test_switching_between_items_does_not_write_the_fact(spark, tmp_path):
    _without_the_fact(spark, str(tmp_path), "x9_cannibalisation_switching")
