"""Every registered query against its DuckDB oracle on the smallest fixture scale."""

import pytest

from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def _names():
    from pricelens.plans.registry import spark_queries
    return list(spark_queries())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SF)
    assert r["status"].startswith("ok") or r["status"] == "no-oracle", r


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "gross_margin" in df.columns
