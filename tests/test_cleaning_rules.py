"""Hand-made rows for each cleaning rule and null rule (the adapter cannot produce all cases)."""

from pyspark.sql import functions as F

from pricelens.operators import cleaning
from pricelens.sources.schemas import SALES_RAW


def _raw(spark, rows):
    full = []
    for r in rows:
        d = dict(customer_code="C1", customer_name="ACME", region=None, invoice_number="1", document_type=None,
                 invoice_date="2001-01-01", item_code="I1", item_description="d", quantity=1.0, currency="EUR",
                 unit_price=1.0, line_total=None)
        d.update(r)
        if d["line_total"] is None and d["quantity"] is not None and d["unit_price"] is not None:
            d["line_total"] = d["quantity"] * d["unit_price"]
        full.append(tuple(d[f.name] for f in SALES_RAW.fields))
    return spark.createDataFrame(full, SALES_RAW)


def test_rules_closed_form(spark):
    raw = _raw(spark, [
        dict(invoice_number="inv_neg_qty", quantity=-2.0, unit_price=-3.0),     # INV (q*p>0), rule 2
        dict(invoice_number="return", quantity=-2.0, unit_price=3.0),           # CRN, rule 3
        dict(invoice_number="rebate_price", quantity=2.0, unit_price=-3.0),     # CRN, rules 1 and 4
        dict(invoice_number="meter", quantity=2.5, unit_price=3.0),             # rule 5
        dict(invoice_number="near_zero", quantity=1.0, unit_price=0.05),        # rule 6
        dict(invoice_number="free", quantity=3.0, unit_price=0.0),              # rule 7
        dict(invoice_number="gbp", quantity=1.0, unit_price=10.0, currency="GBP"),
        dict(invoice_number="eur_lower", currency="Eur"),
        dict(invoice_number="null_total", quantity=None),                       # NULL -> INV, no flags
    ])
    out = {r["invoice_number"]: r for r in cleaning.apply_business_rules(raw).collect()}
    assert out["inv_neg_qty"]["document_type"] == "INV" and out["inv_neg_qty"]["quantity"] == 2.0
    assert out["inv_neg_qty"]["data_quality_issue"] == cleaning.NEGATIVE_QTY_ISSUE
    assert out["return"]["document_type"] == "CRN" and out["return"]["is_return"] == 1
    assert out["return"]["quantity"] == -2.0 and out["return"]["is_rebate"] == 0
    assert out["rebate_price"]["is_rebate"] == 1 and out["rebate_price"]["is_return"] == 0
    assert out["meter"]["unit_type"] == "meter"
    assert out["near_zero"]["is_sample"] == 1 and out["free"]["is_sample"] == 1
    assert abs(out["gbp"]["unit_price"] - 11.5) < 1e-9 and out["gbp"]["currency"] == "EUR"
    assert out["eur_lower"]["currency"] == "EUR"
    n = out["null_total"]
    assert n["document_type"] == "INV" and n["is_sample"] == 0 and n["is_rebate"] == 0 and n["unit_type"] is None


def test_rule8_never_fires(spark):
    # Rule 8 (INV, price > 0, qty < 0) would need q*p < 0 on an INV line: impossible, it is a CRN.
    raw = _raw(spark, [dict(quantity=-1.0, unit_price=5.0)])
    r = cleaning.apply_business_rules(raw).collect()[0]
    assert r["document_type"] == "CRN" and r["data_quality_issue"] is None


def test_name_standardisation_mode_and_ties(spark):
    raw = _raw(spark, [dict(customer_name="B"), dict(customer_name="A"), dict(customer_name="A"),
                       dict(customer_code="C2", customer_name="Z"), dict(customer_code="C2", customer_name="Y"),
                       dict(customer_code="C3", customer_name=None), dict(customer_code="C3", customer_name=None),
                       dict(customer_code="C3", customer_name="Q"),
                       dict(customer_code=None, customer_name="NOCODE")])
    names = {r["customer_code"]: r["standard_name"] for r in cleaning.standard_names(raw).collect()}
    assert names == {"C1": "A", "C2": "Y", "C3": None}
    cleaned = cleaning.clean_sales(raw)
    assert cleaned.filter(F.col("customer_code").isNull()).collect()[0]["customer_name"] is None
    variations = {r["customer_code"]: r for r in cleaning.name_variations(raw).collect()}
    assert variations["C1"]["original_names"] == ["A", "B"] and variations["C1"]["occurrences"] == 3


def test_dedup_keeps_first_loaded_and_null_keys(spark):
    df = spark.createDataFrame([(3, "X", 1.0), (1, "X", 2.0), (2, None, 3.0), (4, None, 4.0), (5, "Y", 5.0)],
                               "load_key long, item_code string, landed_cost_euro double")
    out = sorted((r["item_code"] or "", r["landed_cost_euro"]) for r in cleaning.dedup_first(df).collect())
    assert out == [("", 3.0), ("", 4.0), ("X", 2.0), ("Y", 5.0)]
    twice = cleaning.dedup_first(cleaning.dedup_first(df))
    assert twice.count() == 4  # idempotent


def test_drop_empty_pallets(spark):
    df = spark.createDataFrame([("A", 1, 1, 1), ("", 1, 1, 1), (None, 1, 1, 1)],
                               "item_code string, pallet_quantity long, carton_quantity long, single_quantity long")
    assert [r["item_code"] for r in cleaning.drop_empty_pallets(df).collect()] == ["A"]
