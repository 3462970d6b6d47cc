"""A16 on the raw tables: duplicates, name variations and blank codes are still there."""

from pyspark.sql import functions as F

from pricelens.operators import audit
from pricelens.plans.registry import engine_for

SF = "/root/testdata/sf0.001"


def test_duplicates_variations_and_blank_codes_are_shown(spark):
    raw = engine_for(spark, SF).raw
    code = raw.catalogue_prices.groupBy("item_code").count().where("count > 1").orderBy("item_code").first()[0]
    names = raw.sales_raw.groupBy("customer_code").agg(F.count_distinct("customer_name").alias("n"))
    customer = names.where("n > 1 AND customer_code IS NOT NULL").orderBy("customer_code").first()[0]
    got = audit.raw_row_samples(raw, code, customer)
    assert got["c"].count() > 1 and got["e"].count() > 1 and 0 < got["d"].count() <= 5
