"""The registered queries on the smallest tables, and the pipeline stage by stage."""

import pyarrow as pa
import pytest

from pricelens.llm import decontam, jaccard, quality
from tests.oracle_compare import compare, duck
from .helpers import AWKWARD, SF, documents


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def _oracles():
    import __spark_entry__ as E
    from pricelens.llm import queries
    return [n for n in E.oracle_sql() if n in queries.QUERIES]


@pytest.mark.parametrize("name", _oracles())
def test_query_matches_its_sql(spark, con, name):
    import __spark_entry__ as E
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert r["status"] == "ok", r


def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__ as E
    names = list(E.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_pipeline_follows_its_stages(spark):
    import corpus_pipeline
    from pricelens.llm import common, decontam, jaccard, quality, queries, tokens
    from . import test_tokens
    docs = common.read_table(spark, SF, "documents")
    kept = quality.score(docs, quality.fit(docs, common.read_table(spark, SF, "labels"), queries.fold("doc_id", 5) != 0))
    good = {r["doc_id"] for r in kept.collect() if r["score"] >= quality.THRESHOLD}
    step = docs.where(docs["doc_id"].isin(sorted(good)))
    heads = {r["doc_id"] for r in jaccard.classes(step).collect() if r["kept"]}
    step = step.where(step["doc_id"].isin(sorted(heads)))
    clean = {r["doc_id"] for r in decontam.scan(step, common.read_table(spark, SF, "benchmark")).collect()
             if not r["contaminated"]}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == clean and len(out) == len(clean)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    in_order = sorted(out, key=lambda r: r["start"])
    assert [tuple(r) for r in in_order] == test_tokens.brute([(r["doc_id"], texts[r["doc_id"]]) for r in in_order])
    assert [r["doc_id"] for r in in_order] != sorted(clean)  # the mix decides the order
    from pricelens.llm import mixing
    mix = step.where(step["doc_id"].isin(sorted(clean)))
    placed = mixing.placed(mix).select("doc_id", "mix_slot", "mix_before", "mix_order").collect()
    assert [r["doc_id"] for r in in_order] == [r["doc_id"] for r in sorted(placed, key=lambda r: tuple(r)[1:])]
    assert tokens.END_ID == 2


def test_stages_keep_the_columns_of_their_rows(spark):
    import corpus_pipeline
    docs = documents(spark, AWKWARD).repartition(2)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert stage is corpus_pipeline.source_mix
    name, last = corpus_pipeline.STAGES[-1]
    assert last(spark, docs, SF).count() == len(AWKWARD)


def test_tasks_give_small_batches():
    rows = pa.table({"doc_id": range(5000), "text_hash": range(5000), "text": [f"some words of text {i}" for i in range(5000)]})
    batch = rows.combine_chunks().to_batches()[0]
    index = decontam.build_index([("a", b"not in any of them")], {})
    for task in (quality._keep_task(quality.train([]), 2, 0.3), jaccard._set_task(5),
                 decontam._clean_task(index, 3, 2, 20), decontam._scan_task(index, 3, True)):
        sizes = [b.num_rows for b in task(iter([batch]))]
        assert sum(sizes) == 5000 and max(sizes) <= 512
