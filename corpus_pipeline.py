"""The training-corpus pipeline: documents in, token files out.

Each stage gets the rows its predecessor kept (written as Parquet and read again), and
all but the last return the columns of ``documents``.  The mixing stage returns every row
it gets; its decision is the order of the rows, which the last stage takes from the
files (file name, then row) so that the token files follow the mix.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm import common, decontam, jaccard, mixing, quality, queries, tokens

#: Chunks that a worker's encoder keeps of a generation: the stages before have left memory of theirs in it.
REMEMBERED = 400_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels outside fold 0."""
    labels = common.read_table(spark, sf_dir, "labels")
    return quality.keep_good(docs, quality.fit(docs, labels, learn=queries.fold("doc_id", 5) != 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return jaccard.one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't make up a twentieth of."""
    return decontam.decontaminate(docs, common.read_table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the sources interleaved to their target weights."""
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids stand in the token files, read back from them."""
    order = None
    try:
        # part files by number: as text, part-100000 would stand before part-99999
        number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).try_cast("long")
        docs = docs.select("doc_id", "text", F.struct(number.alias("number"), F.col("_metadata.file_name").alias("name")).alias("_file"),
                           F.col("_metadata.row_index").alias("_row"))
        order = [F.col("_file"), F.col("_row")]
    except AnalysisException:  # not read from files: there is no order to keep but doc_id's
        pass
    manifest = tokens.write(docs, queries.tokenizer_path(), order, remembered=REMEMBERED)
    return tokens.read(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_files),
]

#: The classifier, the tokenizer and the order of files are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
