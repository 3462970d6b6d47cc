"""Merging sales batches into the silver layer, version by version.

A version of the layer under ``path`` is three tables:

* ``name_counts/version=N``: rows per (customer_code, customer_name) of everything merged so far;
* ``fact_versions/version=N/invoice_year=Y``: the enriched lines that version N wrote;
* ``manifest/version=N``: the (invoice_year, written_by) folders that make up the fact as of N.

P16 gives a code its most frequent name, so a batch can rename lines of earlier ones.  ``merge_sales``
compares the names before and after, rewrites the years that hold lines of renamed customers,
and only adds a folder to the others; a year in over ``COMPACT_AFTER`` folders is rewritten into one.
The manifest is written last.  Readers take the newest one, so they see whole versions only,
and a batch that failed or is delivered again changes nothing: its folders are replaced, or, where its
manifest exists, it is skipped.  Folders that no manifest in use names may be removed at any time.

What comes to the driver is the manifest: a row a year and folder.  Cases: an empty batch is a version like the one before;
lines without a date are in a folder of their own; a null code has no standard name, as in ``clean_sales``; the catalogue
and the costs are those that ``start`` was given, a change of them needs a rebuild.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..operators import cleaning
from ..operators.facts import Tables, enrich
from ..session import shared_checkpoint_dir
from ..sources import files, schemas
from ..sources.sinks import TABLES

COMPACT_AFTER = 16
DIMENSIONS = TABLES[1:]
_NO_YEAR = "none"  # the folder of lines without a date


def start(tables: Tables, path: str) -> None:
    """Lay down the dimension tables of ``tables`` for a layer whose sales come in batches."""
    for name in DIMENSIONS:
        getattr(tables, name).write.mode("overwrite").parquet(f"{path}/{name}")


def _manifest(spark: SparkSession, path: str, below: int | None = None) -> tuple[int, list[tuple[str, int]]] | None:
    """The newest version (under ``below``) and its (invoice_year, written_by) folders."""
    try:
        rows = spark.read.parquet(f"{path}/manifest")
    except AnalysisException:  # nothing merged so far
        return None
    if below is not None:
        rows = rows.where(F.col("version") < below)
    version = rows.agg(F.max("version")).first()[0]
    if version is None:
        return None
    kept = rows.where((F.col("version") == version) & F.col("invoice_year").isNotNull())
    return version, [(r["invoice_year"], r["written_by"]) for r in kept.collect()]


def _lines(spark: SparkSession, path: str, folders: list[tuple[str, int]]) -> DataFrame:
    """The fact lines in the folders, with their ``invoice_year`` as text and the ``version`` that wrote them."""
    rows = spark.read.schema(_fact_schema(spark, path)).parquet(f"{path}/fact_versions")
    wanted = F.lit(False)  # on the folders' columns only, so no other folder is opened
    for v in sorted({v for _, v in folders}):
        wanted = wanted | ((F.col("version") == v) & F.col("invoice_year").isin([y for y, w in folders if w == v]))
    return rows.where(wanted)


def _fact_schema(spark: SparkSession, path: str):
    empty = spark.createDataFrame([], schemas.SALES).select(*cleaning.SALES_COLUMNS)
    return enrich(_tables(spark, path, empty)).schema.add("version", "long").add("invoice_year", "string")


def _tables(spark: SparkSession, path: str, sales: DataFrame) -> Tables:
    return Tables(sales=sales, **{n: spark.read.parquet(f"{path}/{n}") for n in DIMENSIONS})


def _names(counts: DataFrame) -> DataFrame:
    key = F.struct(-F.col("cnt"), F.col("customer_name").isNull(), F.col("customer_name"))
    return counts.groupBy("customer_code").agg(F.min_by("customer_name", key).alias("standard_name"))


def merge_sales(spark: SparkSession, path: str, ruled: DataFrame, version: int) -> bool:
    """Merge ``ruled`` lines (rules P1-P12 applied, names as delivered) as ``version``; False where it was merged before."""
    newest = _manifest(spark, path)
    if newest is not None and newest[0] >= version:
        return False
    folders = newest[1] if newest else []
    counts = cleaning.customer_name_counts(ruled)
    earlier = spark.read.parquet(f"{path}/name_counts/version={newest[0]}") if newest else None
    if earlier is not None:
        counts = counts.unionByName(earlier).groupBy("customer_code", "customer_name").agg(F.sum("cnt").alias("cnt"))
    counts.write.mode("overwrite").parquet(f"{path}/name_counts/version={version}")
    names = _names(spark.read.parquet(f"{path}/name_counts/version={version}"))

    named = cleaning.with_standard_names(ruled, names)
    year = F.coalesce(F.nullif(F.substring("invoice_date", 1, 4), F.lit("")), F.lit(_NO_YEAR))
    out = enrich(_tables(spark, path, named.select(*cleaning.SALES_COLUMNS))).withColumn("invoice_year", year)
    rewritten = _years_to_rewrite(spark, path, folders, earlier, names)
    if rewritten:
        old = _lines(spark, path, [f for f in folders if f[0] in rewritten]).drop("version")
        out = out.unionByName(cleaning.with_standard_names(old, names))
    written = f"{path}/fact_versions/version={version}"
    # by the tasks of the last join: a shuffle by year would move all written lines once more
    (out.sortWithinPartitions("invoice_year", "invoice_date")
     .write.mode("overwrite").option("compression", "zstd").partitionBy("invoice_year").parquet(written))
    new = _written_years(spark, path, version)
    kept = [f for f in folders if f[0] not in rewritten] + [(y, version) for y in new]
    # an empty layer is a version too: its manifest has one row without a year
    spark.createDataFrame(kept or [(None, None)], "invoice_year string, written_by long").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/manifest/version={version}")
    return True


def _written_years(spark: SparkSession, path: str, version: int) -> list[str]:
    """The years of a version's folders: no column of the files is read."""
    rows = spark.read.schema(_fact_schema(spark, path)).parquet(f"{path}/fact_versions").where(F.col("version") == version)
    return [r[0] for r in rows.select("invoice_year").distinct().collect()]


def _years_to_rewrite(spark: SparkSession, path: str, folders: list[tuple[str, int]], earlier: DataFrame | None,
                      names: DataFrame) -> set[str]:
    """Years with lines of renamed customers, and years in too many folders."""
    count: dict[str, int] = {}
    for y, _ in folders:
        count[y] = count.get(y, 0) + 1
    years = {y for y, n in count.items() if n >= COMPACT_AFTER}
    if folders and earlier is not None:
        before = _names(earlier).withColumnRenamed("standard_name", "_before")
        renamed = names.join(before, "customer_code").where(~F.col("standard_name").eqNullSafe(F.col("_before")))
        touched = _lines(spark, path, [f for f in folders if f[0] not in years]) if len(years) < len(count) else None
        if touched is not None:
            found = touched.join(renamed.select("customer_code"), "customer_code", "left_semi").select("invoice_year").distinct()
            years |= {r["invoice_year"] for r in found.collect()}
    return years


def engine(spark: SparkSession, path: str, as_of: str = "2001-08-01", version: int | None = None) -> Engine:
    """An Engine over the newest version of the layer (or the newest up to ``version``)."""
    found = _manifest(spark, path, None if version is None else version + 1)
    if found and found[1]:
        fact = _lines(spark, path, found[1]).drop("version")  # date windows prune its year folders
    else:
        fact = spark.createDataFrame([], _fact_schema(spark, path)).drop("version")
    tables = _tables(spark, path, fact.select(*cleaning.SALES_COLUMNS))
    return Engine(tables, as_of, fact=fact)


#: What the stream reads of each file; its contents are read by the batch import.
_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def start_merging(spark: SparkSession, landing: str, path: str, trigger_once: bool = True,
                  max_files_per_trigger: int = 1000) -> StreamingQuery:
    """Merge every new sales file in ``landing`` into the layer under ``path``; returns the running query.

    The stream tells the new files' names, at most ``max_files_per_trigger`` a batch; ``read_sales`` reads them, so headers, quoted
    line ends and blank rows are treated as in the batch import.  Batch N is version N + 1."""
    stream = (spark.readStream.format("binaryFile").schema(_FILE_SCHEMA)
              .option("maxFilesPerTrigger", max_files_per_trigger).load(landing).select("path"))

    def merge(batch: DataFrame, batch_id: int) -> None:
        paths = [r["path"] for r in batch.collect()]
        if paths:
            merge_sales(spark, path, cleaning.apply_business_rules(files.read_sales(spark, paths)), batch_id + 1)

    name = hashlib.sha256(f"{landing}\n{path}".encode()).hexdigest()[:16]
    writer = stream.writeStream.foreachBatch(merge).option(
        "checkpointLocation", f"{shared_checkpoint_dir(spark).rstrip('/')}/sales-merge-{name}")
    writer = writer.trigger(availableNow=True) if trigger_once else writer.trigger(processingTime="1 minute")
    return writer.start()
