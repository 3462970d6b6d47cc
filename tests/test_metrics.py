from pyspark.sql import functions as F

from pricelens.functions import metrics as M
from pricelens.functions.periods import period_key


def test_rounding_and_ratios(spark):
    df = spark.createDataFrame([(12.345, 10.0, 0.0, None)], "r double, c double, z double, n double")
    r = df.select(M.round_half_up("r").alias("a"), M.margin("r", "c").alias("m"),
                  M.margin_percent("z", "c").alias("mp0"), M.average("r", F.lit(0)).alias("avg0"),
                  M.percentage_of_total("c", "n").alias("p0"), M.margin("n", "n").alias("mn")).collect()[0]
    assert r["a"] == 12.35 and r["m"] == 2.35 and r["mp0"] == 0.0 and r["avg0"] == 0.0
    assert r["p0"] == 0.0 and r["mn"] == 0.0


def test_js_null_rules(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, None), (3.0, "a")], "x double, k string")
    r = df.agg(M.js_sum("x").alias("s"), M.js_mean("x").alias("m"), M.js_distinct_count("k").alias("d")).collect()[0]
    assert r["s"] == 4.0 and abs(r["m"] - 4.0 / 3) < 1e-12 and r["d"] == 2


def test_discount_percent(spark):
    df = spark.createDataFrame([(2.0, 18.0, 10.0), (0.0, 5.0, 10.0), (1.0, 5.0, None)], "q double, lt double, b double")
    got = [r[0] for r in df.select(M.discount_percent("q", "lt", "b")).collect()]
    assert got == [10.0, 0.0, 0.0]


def test_period_keys(spark):
    df = spark.createDataFrame([("2001-01-01",), ("2000-12-31",)], "d string")
    keys = df.select(period_key("d", "week").alias("w"), period_key("d", "quarter").alias("q"),
                     period_key("d", "week", "reference").alias("r")).collect()
    assert keys[0]["w"] == "2001-W01" and keys[1]["w"] == "2000-W52" and keys[0]["q"] == "2001-Q1"
    assert keys[0]["r"] == "2001-W01" and keys[1]["r"] == "2000-W06"


def test_deviations_neither_cancel_nor_overflow(spark):
    from pricelens.functions import metrics as M
    def one(values, other=None):
        df = spark.createDataFrame([(float(v), float(o)) for v, o in zip(values, other or values)], "v double, o double")
        return df.agg(M.exact_stddev_pop("v").alias("s"), M.exact_covar_pop("v", "o").alias("c")).first()
    assert one([2e9, 2e9 + 1] * 50)["s"] == 0.5
    assert abs(one([3e7, 3e7 + 0.1] * 500)["s"] - 0.05) < 1e-12
    assert abs(one([-3e7, -3e7 - 0.1] * 500)["s"] - 0.05) < 1e-12
    assert one([7.25] * 9)["s"] == 0.0 and one([-1.0, 1.0])["s"] == 1.0
    assert one([1, 2, 3, 4], [8, 6, 4, 2])["c"] == -2.5
    assert abs(one([9e12, -9e12] * 100)["s"] / 9e12 - 1) < 1e-9  # beyond 38 digits: the double aggregate


def test_a_limit_of_zero_gives_no_rows(spark):
    from pricelens.functions import metrics as M
    df = spark.range(5)
    assert M.top(df, "id", "desc", 0).count() == 0 and M.top(df, "id", "desc", None).count() == 5


def test_list_helpers(spark):
    df = spark.createDataFrame([(1, -2.0, 5, 30.0), (2, 0.0, 9, 20.0), (3, 4.0, 10, None)],
                               "id int, margin double, transaction_count int, discount_percent double")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(M.filter_negative_margins(df)) == [1]
    assert ids(M.filter_negative_margins(df.drop("margin"))) == []
    assert ids(M.filter_high_discounts(df, 20)) == [1]
    assert ids(M.filter_min_transactions(df, 9)) == [2, 3]
    assert [r["id"] for r in M.paginate(df.orderBy("id"), 2, 2).collect()] == [3]
    assert M.paginate(df.orderBy("id"), 3, 2).count() == 0
    got = df.select(M.round_to("discount_percent", 0), M.round_to(F.lit(2.675))).collect()
    assert [r[0] for r in got] == [30.0, 20.0, 0.0] and got[0][1] == 2.68
