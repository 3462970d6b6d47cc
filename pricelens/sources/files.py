"""Import the source files (CSV with headers) into typed tables.

Every column is read as text (no inference), blank rows are dropped, blank cells
become NULL and numeric columns are parsed with ``try_cast`` of their numeric
prefix (JavaScript ``parseFloat`` semantics, N8).  A load ordinal taken on the scan
itself (file, block offset, row id) gives "first row wins" deduplication a
well-defined order without any single-task numbering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

NUMERIC_PREFIX = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"


def parse_float(c: Column) -> Column:
    """``parseFloat``: the leading number of the text, else NULL."""
    return F.regexp_extract(c, NUMERIC_PREFIX, 1).try_cast("double")


def _blank_to_null(c: Column) -> Column:
    """Empty cells are NULL; cells of white space are kept as they are (K2)."""
    return F.when(c == "", F.lit(None).cast("string")).otherwise(c)


def iso_date(c: Column) -> Column:
    """``DD/MM/YYYY`` -> ``YYYY-MM-DD``: shorter parts are padded to two digits, longer ones kept whole."""
    parts = F.split(F.trim(c), "/")
    padded = [F.when(F.length(p) < 2, F.lpad(p, 2, "0")).otherwise(p) for p in (parts[1], parts[0])]
    return F.when(F.size(parts) == 3, F.concat_ws("-", parts[2], *padded))


def _cells(raw: DataFrame, headers: dict[str, str]) -> DataFrame:
    """The wanted columns of a reader's rows, as text, with the file, the block and the row's place in it."""
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_block"))
    found = {c.lstrip("\ufeff").strip(): c for c in raw.columns}
    return raw.select("_file", "_block", F.monotonically_increasing_id().alias("_row"), *[
        (F.col(f"`{found[h.strip()]}`") if h.strip() in found else F.lit(None).cast("string")).alias(h)
        for h in headers])


def read_csv(spark: SparkSession, path: str, headers: dict[str, str], numeric: set[str] = frozenset(),
             integer: set[str] = frozenset()) -> DataFrame:
    """Header CSV -> table with the source->target column map.

    Columns are found by their header, in any order; further columns are ignored and a
    missing one is NULL.  Cells follow RFC 4180: quotes are doubled inside quotes, and a
    quoted cell may hold line ends.  A first pass over the lines finds the files with such cells
    (some line has an odd number of quotes); these are read whole, one task a file, and all
    others are split into blocks like any text.  All files of one import must have the same header."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    broken = [r["_file"] for r in lines.filter(quotes % 2 == 1).select("_file").distinct().collect()]  # file names only
    options = {"header": True, "enforceSchema": False, "mode": "PERMISSIVE", "quote": '"', "escape": '"'}
    if not broken:
        raw = _cells(spark.read.options(**options).csv(path), headers)
    else:  # the header may itself hold a line end, so its columns come from the whole-file reader
        whole = spark.read.options(**options, multiLine=True).csv(path)
        split = spark.read.options(**options).schema(whole.schema).csv(path)
        in_broken = F.col("_metadata.file_path").isin(broken)  # prunes the files before they are opened
        raw = _cells(whole.filter(in_broken), headers).unionByName(_cells(split.filter(~in_broken), headers))
    nonblank = F.lit(False)
    for h in headers:
        nonblank = nonblank | F.coalesce(F.trim(F.col(f"`{h}`")) != "", F.lit(False))
    cols = []
    for h, target in headers.items():
        c = _blank_to_null(F.col(f"`{h}`"))
        if target in numeric:
            c = parse_float(c)
        elif target in integer:
            c = parse_float(c).try_cast("long")
        cols.append(c.alias(target))
    load_key = F.struct(F.col("_file"), F.col("_block"), F.col("_row"))
    return raw.filter(nonblank).select(load_key.alias("load_key"), *cols)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """S2."""
    return read_csv(spark, path, schemas.CATALOGUE_HEADERS,
                    numeric={"ie_trade", "ie_high", "ie_mid", "ie_low", "ie_base", "ie_edm", "ie_anew"})


def read_landed_costs(spark: SparkSession, path: str) -> DataFrame:
    """S3."""
    return read_csv(spark, path, schemas.LANDED_COST_HEADERS, numeric={"landed_cost_euro", "plus_5_percent"})


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    """Sales export; ``DD/MM/YYYY`` -> ``YYYY-MM-DD`` when it has exactly 3 parts."""
    df = read_csv(spark, path, schemas.SALES_HEADERS, numeric={"quantity", "unit_price"})
    iso = iso_date(F.col("invoice_date"))
    return (df.withColumn("invoice_date", iso)
              .withColumn("line_total", F.col("quantity") * F.col("unit_price"))
              .select(*[f.name for f in schemas.SALES_RAW.fields]))


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    """Customer master exported from the workbook's first sheet."""
    return read_csv(spark, path, schemas.CUSTOMER_HEADERS).drop("load_key")


def read_pallets(spark: SparkSession, path: str) -> DataFrame:
    """Pallet sizes (note the trailing space in ``Carton Quantity ``)."""
    return read_csv(spark, path, schemas.PALLET_HEADERS,
                    integer={"pallet_quantity", "carton_quantity", "single_quantity"}).drop("load_key")


def write_export(df: DataFrame, headers: dict[str, str], path: str, dates: tuple[str, ...] = ()) -> None:
    """Append ``df`` to ``path`` as the source files look: their headers, RFC 4180 cells, ``DD/MM/YYYY`` dates."""
    def cell(c: str) -> Column:
        return F.date_format(F.to_date(c), "dd/MM/yyyy") if c in dates else F.col(c).cast("string")
    (df.select(*[cell(c).alias(h) for h, c in headers.items()])
     .write.mode("append").options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                                   ignoreTrailingWhiteSpace=False).csv(path))


def write_table(df: DataFrame, path: str, reset: bool = False) -> None:
    """Append to an existing table, or replace it with ``reset``."""
    df.write.mode("overwrite" if reset else "append").parquet(path)


def import_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per imported table."""
    parts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
