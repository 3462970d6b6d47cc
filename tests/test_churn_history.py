"""X6 over all history: customers who bought nothing in the two periods are in it."""

from pricelens.operators import extended
from pricelens.plans.queries_trends import LAST_YEAR
from pricelens.plans.registry import WHOLE, engine_for

SF = "/root/testdata/sf0.001"


def test_customers_gone_for_over_a_year_are_in_the_report(spark):
    gone = engine_for(spark, SF).fact.where("invoice_date < '2000-08-02'")
    lines = gone.where("document_type IN ('INV', 'CRN') AND is_sample = 0 AND is_return = 0 AND customer_code IS NOT NULL")
    customers = {r[0] for r in lines.select("customer_code").distinct().collect()}
    assert customers and extended.churn_decline(gone, LAST_YEAR).count() == 0
    rows = extended.churn_decline(gone, LAST_YEAR, history=WHOLE).collect()
    assert {r["customer_code"] for r in rows} == customers
    assert all(r["previous_period_revenue"] == r["current_period_revenue"] == 0 for r in rows)
    assert {r["risk_level"] for r in rows if r["lifetime_revenue"] > 10000} == {"high"}
