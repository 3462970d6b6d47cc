"""CSV imports (S1-S8) and the streaming ingest on hand-made files."""

import os
import tempfile

from pyspark.sql import functions as F

from pricelens.operators import cleaning
from pricelens.sources import files

SALES_CSV = (
    "Customer Code,Customer Name,Region,Document Number,Document Type,Document Date,Item SKU,Item Description,"
    "Item Quantity,Currency,Price\r\n"
    "C1,Acme,EU,100,INV,03/02/2001,85ABC ,Widget,2,GBP,10\r\n"
    ",,,,,,,,,,\r\n"
    "C1,ACME,EU,101,INV,3/2/2001,X1,Widget,-1,EUR,4.5abc\r\n"
    "C2,Beta,EU,102,INV,bad-date,X1,,1.5,Eur,3\r\n")


def _write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write(text)
    return folder


def test_sales_import(spark):
    d = _write(tempfile.mkdtemp(), "sales.csv", SALES_CSV)
    rows = {r["invoice_number"]: r for r in files.read_sales(spark, d).collect()}
    assert set(rows) == {"100", "101", "102"}  # blank row dropped
    assert rows["100"]["invoice_date"] == "2001-02-03" and rows["101"]["invoice_date"] == "2001-02-03"
    assert rows["102"]["invoice_date"] is None
    assert rows["100"]["item_code"] == "85ABC "  # codes stay text, spaces kept (K1, K2)
    assert rows["101"]["unit_price"] == 4.5 and rows["101"]["line_total"] == -4.5
    assert rows["102"]["item_description"] is None


def test_dimension_import_and_first_row_dedup(spark):
    d = _write(tempfile.mkdtemp(), "cost.csv",
               "ITEM CODE,Landed cost Euro,Plus 5%\r\nA,1.0,1.05\r\n,,\r\nA,2.0,2.1\r\nB,,\r\n")
    costs = files.read_landed_costs(spark, d)
    assert costs.count() == 3
    dedup = {r["item_code"]: r["landed_cost_euro"] for r in cleaning.dedup_first(costs).collect()}
    assert dedup == {"A": 1.0, "B": None}
    summary = {r["table_name"]: r["row_count"] for r in files.import_summary({"landed_costs": costs}).collect()}
    assert summary == {"landed_costs": 3}


def test_pallet_import_trailing_space_header(spark):
    d = _write(tempfile.mkdtemp(), "pallets.csv",
               "ITEM CODE,Pallet Quantity,Carton Quantity ,Single Quantity\nP1,40,10,1\n,,,\n ,1,1,1\n")
    p = cleaning.drop_empty_pallets(files.read_pallets(spark, d))
    # K2: a code of white space is text, and P15 deletes NULL and '' only
    assert sorted((r["item_code"], r["carton_quantity"]) for r in p.collect()) == [(" ", 1), ("P1", 10)]


def test_streaming_ingest(spark):
    from pricelens.streaming.incremental import standardised_sales, start_sales_ingest
    root = tempfile.mkdtemp()
    landing = _write(os.path.join(root, "landing"), "part1.csv", SALES_CSV)
    q = start_sales_ingest(spark, landing, os.path.join(root, "sales"), os.path.join(root, "names"))
    q.awaitTermination(120)
    out = standardised_sales(spark, os.path.join(root, "sales"), os.path.join(root, "names"))
    rows = {r["invoice_number"]: r for r in out.collect()}
    assert rows["100"]["currency"] == "EUR" and abs(rows["100"]["unit_price"] - 11.5) < 1e-9
    assert len(rows) == 3  # blank row dropped
    assert rows["101"]["document_type"] == "CRN" and rows["101"]["is_return"] == 1
    assert rows["102"]["unit_type"] == "meter"
    assert {rows["100"]["customer_name"], rows["101"]["customer_name"]} == {"ACME"}  # tie -> smallest name


def test_columns_are_found_by_header_and_cells_follow_rfc_4180(spark):
    d = _write(tempfile.mkdtemp(), "cost.csv",
               'Extra,Landed cost Euro,ITEM CODE\r\nx,1.5,"12"" pipe, red"\r\ny,2.5,"two\nlines"\r\nz,3.5,"   "\r\n')
    rows = {r["item_code"]: r["landed_cost_euro"] for r in files.read_landed_costs(spark, d).collect()}
    assert rows == {'12" pipe, red': 1.5, "two\nlines": 2.5, "   ": 3.5}


def test_only_files_with_quoted_line_ends_are_read_whole(spark):
    d = tempfile.mkdtemp()
    head = "ITEM CODE,Landed cost Euro,Plus 5%\n"
    _write(d, "a plain.csv", head + "".join(f'"I ""{i}""",{i}.5,\n' for i in range(20_000)))
    _write(d, "b%20.csv", head + '"two\nlines",1,2\n' + ''.join(f"B{i},{i},\n" for i in range(100)) + '"x\n\ny",3,\n')
    want = {f'I "{i}"': i + 0.5 for i in range(20_000)} | {f"B{i}": float(i) for i in range(100)} | {"two\nlines": 1.0, "x\n\ny": 3.0}
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = files.read_landed_costs(spark, d)
        rows = df.collect()
        assert df.rdd.getNumPartitions() > 4  # the plain file is split
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(rows) == len(want) and {r["item_code"]: r["landed_cost_euro"] for r in rows} == want
    order = [r["item_code"] for r in sorted(rows, key=lambda r: tuple(r["load_key"]))]
    plain = [c for c in order if c.startswith('I "')]
    assert plain == [f'I "{i}"' for i in range(20_000)]  # the load order follows the file across its blocks


def test_a_header_with_a_line_end(spark):
    d = _write(tempfile.mkdtemp(), "a.csv", '"Other\ncolumn",ITEM CODE,Landed cost Euro\nx,I1,2\n')
    assert [(r["item_code"], r["landed_cost_euro"]) for r in files.read_landed_costs(spark, d).collect()] == [("I1", 2.0)]


def test_dates_keep_long_parts(spark):
    df = spark.createDataFrame([("1/2/2001",), ("001/02/2001",), ("1/2",), (None,)], "d string")
    assert [r[0] for r in df.select(files.iso_date(F.col("d"))).collect()] == ["2001-02-01", "2001-02-001", None, None]


def test_append_and_reset(spark):
    path = os.path.join(tempfile.mkdtemp(), "t")
    df = spark.createDataFrame([(1,), (2,)], "a int")
    files.write_table(df, path)
    files.write_table(df, path)
    assert spark.read.parquet(path).count() == 4
    files.write_table(df, path, reset=True)
    assert spark.read.parquet(path).count() == 2


def test_retried_batches_and_swapped_headers(spark):
    from pricelens.streaming.incremental import standardised_sales, start_sales_ingest
    root = tempfile.mkdtemp()
    landing = _write(os.path.join(root, "landing"), "part1.csv", SALES_CSV)
    where = os.path.join(root, "sales"), os.path.join(root, "names")
    start_sales_ingest(spark, landing, *where).awaitTermination(120)
    once = standardised_sales(spark, *where).count()
    start_sales_ingest(spark, landing, *where).awaitTermination(120)  # nothing new
    assert standardised_sales(spark, *where).count() == once
    swapped = SALES_CSV.replace("Customer Code,Customer Name", "Customer Name,Customer Code")
    other = _write(os.path.join(root, "other"), "part1.csv", swapped)
    query = start_sales_ingest(spark, other, os.path.join(root, "sales2"), os.path.join(root, "names2"))
    try:
        query.awaitTermination(120)
        failed = query.exception() is not None
    except Exception:
        failed = True
    assert failed
