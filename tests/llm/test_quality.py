import zlib

from pyspark.sql import functions as F

from pricelens.llm import quality, queries
from .helpers import AWKWARD, documents


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.compression_quality(spark, sf).join(
        spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and quality is not null").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.97 and 1 - sum(bad) / len(bad) > 0.6
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_awkward_rows_and_labels(spark):
    docs = documents(spark, AWKWARD)
    labels = spark.createDataFrame([(4, 1), (5, 1), (9, 0), (9, 1), (8, None), (None, 1)], "doc_id long, quality int")
    learned = {(r["doc_id"], r["quality"]) for r in quality.labelled(docs, labels).collect()}
    assert learned == {(4, 1), (5, 1)}
    assert {r["doc_id"] for r in quality.labelled(docs, labels, F.col("doc_id") > 4).collect()} == {5}
    model = quality.fit(docs, labels)  # one label only: nothing can be told apart
    assert {r["score"] for r in quality.score(docs, model).collect()} == {0.5}
    model = quality.train([(b"clean prose about things " * 9, 1), (b"$$$ ### !!!" * 20, 0)] * 12)
    got = quality.score(docs, model).collect()
    assert len(got) == len(AWKWARD)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1  # null and empty alike
    assert quality.score(docs.limit(0), model).count() == 0
    kept = quality.keep_good(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(AWKWARD)


def test_every_block_of_a_text_counts():
    model = quality.train([(b"clean prose about things " * 9, 1), (b"$$$ ### !!!" * 20, 0)] * 12)
    scorer = quality.Scorer(model)
    clean = b"clean prose about things " * 2000
    assert scorer.sizes(clean + b"$$$ ### !!!" * 9000)[0] < scorer.sizes(clean)[0]
