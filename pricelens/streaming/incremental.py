"""Incremental sales ingestion with Structured Streaming.

New sales export files dropped into a landing folder are parsed (S4), cleaned
with the row-level rules (P1-P12, one narrow projection) and appended to the
silver sales table.  Progress and the file log live under the shared checkpoint
folder, so a restarted or re-scheduled job resumes exactly where it stopped.

Customer-name standardisation (P16) needs the whole history of a code, so each
micro-batch also writes its per-(code, name) counts; readers add them up and pick the
standard name.  Lines and counts of a batch go to folders named by the batch id and
replace what is there, so a batch that is retried changes nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cleaning
from ..session import shared_checkpoint_dir
from ..sources import schemas
from ..sources.files import iso_date, parse_float


def _parse(stream: DataFrame) -> DataFrame:
    cols = []
    for h, target in schemas.SALES_HEADERS.items():
        c = F.when(F.col(f"`{h}`") == "", F.lit(None).cast("string")).otherwise(F.col(f"`{h}`"))
        if target in ("quantity", "unit_price"):
            c = parse_float(c)
        cols.append(c.alias(target))
    nonblank = F.lit(False)
    for h in schemas.SALES_HEADERS:
        nonblank = nonblank | F.coalesce(F.trim(F.col(f"`{h}`")) != "", F.lit(False))
    df = stream.filter(nonblank).select(*cols)
    return (df.withColumn("invoice_date", iso_date(F.col("invoice_date")))
              .withColumn("line_total", F.col("quantity") * F.col("unit_price")))


def start_sales_ingest(spark: SparkSession, landing: str, silver_sales: str, name_counts: str,
                       trigger_once: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the file-stream -> cleaned-sales job; returns the running query."""
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(h, T.StringType(), True) for h in schemas.SALES_HEADERS])
    # enforceSchema off: a file whose header has other or swapped columns fails the batch
    reader = (spark.readStream.schema(schema).option("header", True).option("enforceSchema", False)
              .option("quote", '"').option("escape", '"'))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    parsed = _parse(reader.csv(landing))
    ruled = cleaning.apply_business_rules(parsed)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        cleaning.customer_name_counts(batch).write.mode("overwrite").parquet(f"{name_counts}/batch_id={batch_id}")
        (batch.withColumn("invoice_year", F.substring("invoice_date", 1, 4))
              .write.mode("overwrite").partitionBy("invoice_year").parquet(f"{silver_sales}/batch_id={batch_id}"))

    # progress is kept per landing folder
    name = hashlib.sha256(landing.encode()).hexdigest()[:16]
    writer = (ruled.writeStream.foreachBatch(write_batch)
              .option("checkpointLocation", f"{shared_checkpoint_dir(spark).rstrip('/')}/sales-ingest-{name}"))
    writer = writer.trigger(availableNow=True) if trigger_once else writer.trigger(processingTime="1 minute")
    return writer.start()


def standardised_sales(spark: SparkSession, silver_sales: str, name_counts: str) -> DataFrame:
    """Cleaned sales with P16 names, from the streamed rows and the running name counts."""
    counts = spark.read.parquet(name_counts).groupBy("customer_code", "customer_name").agg(F.sum("cnt").alias("cnt"))
    key = F.struct(-F.col("cnt"), F.col("customer_name").isNull(), F.col("customer_name"))
    names = counts.groupBy("customer_code").agg(F.min_by("customer_name", key).alias("standard_name"))
    sales = spark.read.parquet(silver_sales).drop("invoice_year", "batch_id")
    return (sales.join(names, "customer_code", "left").withColumn("customer_name", F.col("standard_name"))
            .select(*cleaning.SALES_COLUMNS))
