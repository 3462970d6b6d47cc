from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pricelens.llm import mixing
from .helpers import AWKWARD, SF, documents


def test_blocks_lie_in_their_windows_and_no_source_drifts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)  # several buckets a source
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights = {"src0": 5.0, "src1": 3.0, "src2": 0.5}
    rows = mixing.positions(mixing.placed(docs, weights, block_chars=700, period=100), group_slots=8)
    rows = rows.select("doc_id", *mixing.PLACE, "mix_position").collect()
    assert len(rows) == docs.count() == len({r["doc_id"] for r in rows})
    assert sorted(r["mix_position"] for r in rows) == list(range(len(rows)))
    in_order = sorted(rows, key=lambda r: r["mix_position"])
    assert in_order == sorted(rows, key=lambda r: (r["mix_slot"], r["mix_before"], r["mix_order"]))
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in rows)
    by = defaultdict(list)
    for r in in_order:
        by[r["mix_source"]].append(r)
    for own in by.values():  # offsets are the running sum in the order of the mix
        at = 0
        for r in sorted(own, key=lambda r: r["mix_order"]):
            assert r["mix_before"] == at
            at += r["mix_chars"]
    slots = {}
    for r in rows:
        assert slots.setdefault(r["mix_slot"], r["mix_source"]) == r["mix_source"]  # a slot is one source's


def test_columns_named_as_the_operators_own_are_kept(spark):
    names = ["mix_row", "_bucket", "_below", "mix_base", "mix_slots", "_row", "before", *mixing.PLACE]
    docs = documents(spark, AWKWARD)
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.length("text") + i) if n not in docs.columns else docs
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))


def test_awkward_rows_are_all_mixed(spark):
    docs = documents(spark, AWKWARD)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    assert sorted(map(key, out.collect())) == sorted(map(key, docs.collect()))
    assert mixing.mixed(docs.limit(0)).count() == 0
    null = mixing.placed(docs).where("mix_source = ''").select(F.count("*")).first()[0]
    assert null == sum(r[3] is None for r in AWKWARD)


def test_same_mix_for_any_partitioning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = mixing.placed(docs.repartition(1)).select("doc_id", "mix_slot", "mix_before").collect()
    many = mixing.placed(docs.repartition(13)).select("doc_id", "mix_slot", "mix_before").collect()
    assert sorted(one) == sorted(many)


@pytest.mark.parametrize("n", [3, 20, 200])
def test_slots_stay_within_a_block_of_the_exact_weights(spark, monkeypatch, n):
    monkeypatch.setattr(mixing, "RUN", 1000)  # several jobs
    monkeypatch.setattr(mixing, "ROW_BLOCKS", 64)
    weights = {f"s{i:03}": w for i, w in enumerate([n / 2, 0.0, *[1 + i / 7 for i in range(n - 2)]])}
    total, slots = sum(map(Fraction, weights.values())), 2500
    sources = [(s, w, int(Fraction(w) * slots / total) + 1) for s, w in weights.items()]
    plan = mixing.block_slots(spark.createDataFrame(sources, "mix_source string, weight double, blocks long"), 100).collect()
    found = defaultdict(list)
    for r in sorted(plan, key=lambda r: (r["mix_source"], r["mix_row"])):
        found[r["mix_source"]] += r["mix_slots"]
    used = [t for own in found.values() for t in own]
    assert len(used) == len(set(used)) and {s: len(own) for s, own in found.items()} == {s: k for s, _, k in sources}
    for s, own in found.items():
        assert own == sorted(own)
        if weights[s]:
            due = Fraction(weights[s]) / total
            # just before and after each block, at the slots where the deviation is largest
            assert all(abs(k - t * due) < 1 and abs(k + 1 - (t + 1) * due) < 1 for k, t in enumerate(own))
    assert min(found["s001"]) > max(t for s, own in found.items() if s != "s001" for t in own)
