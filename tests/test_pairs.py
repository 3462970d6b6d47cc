"""Pair counting by stripes against plain loops: hot groups, hot items, blocks, null groups."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pricelens.operators import product
from pricelens.operators.pairs import numbered, pair_counts, pair_sums

from .test_plans import plan


def _groups():
    rng = random.Random(7)
    groups = {f"g{i}": set(rng.sample(range(60), rng.randrange(1, 12))) for i in range(80)}
    groups |= {None: set(range(60)), "hot": set(range(10, 58))}
    return {g: {f"i{x:03d}" for x in items} | ({"everywhere"} if g != "g1" else set()) for g, items in groups.items()}


def _table(spark, groups):
    rows = [(g, i, len(i) + (k * 7 + len(str(g))) % 9) for g, items in groups.items() for k, i in enumerate(sorted(items))]
    return spark.createDataFrame(rows, "shop string, item_code string, day int"), {(g, i): d for g, i, d in rows}


@pytest.mark.parametrize("block, stripes", [(1024, 50_000), (8, 5)])
def test_counts_equal_plain_loops(spark, block, stripes):
    groups = _groups()
    rows, _ = _table(spark, groups)
    rows = rows.unionByName(spark.createDataFrame([("g0", None, 1)], rows.schema))
    want = Counter(p for items in groups.values() for p in combinations(sorted(items), 2))
    got = pair_counts(rows, ["shop"], [F.count(F.lit(1)).alias("n")], block=block, stripes=stripes).named("a", "b")
    assert {(r["a"], r["b"]): r["n"] for r in got.collect()} == want


@pytest.mark.parametrize("block, stripes", [(1024, 50_000), (8, 5), (40, 5)])
@pytest.mark.parametrize("least", [1, 2, 5])
def test_sums_with_looked_up_groups_equal_plain_loops(spark, block, stripes, least):
    groups = _groups()
    rows, day = _table(spark, groups)
    n, earlier, later = Counter(), Counter(), Counter()
    for g, items in groups.items():
        for a, b in combinations(sorted(items), 2):
            n[a, b] += 1
            earlier[a, b] += day[g, a] < day[g, b]
            later[a, b] += day[g, b] < day[g, a]
    got = pair_sums(rows, ["shop"], "n", {"up": lambda a, b: F.col(f"{a}_day") < F.col(f"{b}_day"),
                                          "down": lambda a, b: F.col(f"{b}_day") < F.col(f"{a}_day")},
                    least, ["day"], block, stripes).named("a", "b", {"up": "down"})
    assert {(r["a"], r["b"]): (r["n"], r["up"], r["down"]) for r in got.collect()} == {
        p: (k, earlier[p], later[p]) for p, k in n.items() if k >= least}


def test_a_basket_of_5000_items(spark):
    rows = spark.range(5000).select(F.lit(1).alias("shop"), F.format_string("i%05d", "id").alias("item_code")).unionByName(
        spark.createDataFrame([(2, "i00003"), (2, "i04999"), (3, "i00003"), (3, "i04999")], "shop int, item_code string"))
    pairs = pair_counts(rows, ["shop"], [F.count(F.lit(1)).alias("n")])
    assert pairs.counts.count() == 5000 * 4999 // 2
    assert [tuple(r) for r in pairs.where("n > 1").named("a", "b").collect()] == [("i00003", "i04999", 3)]
    hot = pair_sums(rows, ["shop"], "n", {}, 3)  # the basket is looked up, not unfolded
    assert [tuple(r) for r in hot.named("a", "b").collect()] == [("i00003", "i04999", 3)]


def test_numbers_are_distinct_and_small(spark):
    got = [r["id"] for r in numbered(spark.range(20_000).select(F.col("id").cast("string").alias("k")), "k", "id").collect()]
    assert len(set(got)) == 20_000 and 0 < min(got) and max(got) < 1 << 32


def test_pairs_are_not_shuffled(spark):
    """Between unfolding the stripes and counting the pairs there is no exchange."""
    rows, _ = _table(spark, _groups())
    steps = [line for line in plan(pair_counts(rows, ["shop"], [F.count(F.lit(1)).alias("n")]).counts, "simple").splitlines()]
    exchanges = [i for i, line in enumerate(steps) if "Exchange hashpartitioning(_a" in line]
    unfolded = [i for i, line in enumerate(steps) if "Generate explode(_later" in line]
    assert exchanges and unfolded and unfolded[0] < exchanges[0]
    assert not any("Exchange" in line for line in steps[:unfolded[0]])


def test_switching_limit_keeps_the_most_shared(spark):
    from pricelens.operators import extended
    from pricelens.plans import registry
    e = registry.engine_for(spark, "/root/testdata/sf0.001")
    whole = extended.cannibalisation_switching(e.fact, registry.WHOLE, 2).collect()
    top = extended.cannibalisation_switching(e.fact, registry.WHOLE, 2, limit=7).collect()
    key = lambda r: (-r["shared_customers"], r["product_a_code"], r["product_b_code"])
    assert sorted(map(key, top)) == sorted(map(key, whole))[:7]
    assert product.shared_customers(product._lines(e.fact, registry.WHOLE), 2, block=3).count() == len(whole)


def test_stripes_are_shuffled_as_arrays_of_numbers_in_partitions_that_are_not_merged(spark):
    rows = spark.createDataFrame([(g, f"i{i}", 1) for g in range(9) for i in range(12)], "g int, item_code string, day int")
    found = pair_sums(rows, ["g"], "n", {"same": lambda a, b: F.col(f"{a}_day") == F.col(f"{b}_day")}, 2, ["day"])
    assert sorted(map(tuple, found.named("a", "b").collect())) == sorted(
        (*sorted((f"i{i}", f"i{j}")), 9, 9) for i in range(12) for j in range(i))
    text = found.counts._jdf.queryExecution().executedPlan().toString()
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f", {n}), REPARTITION_BY_NUM" in text
    assert found.counts.schema["_b"].dataType.simpleString() == "bigint"


def test_groups_of_any_size_are_collected_by_one_shuffle(spark):
    rows, _ = _table(spark, _groups())
    text = plan(pair_counts(rows, ["shop"], [F.count(F.lit(1)).alias("n")], block=8, stripes=5).counts, "simple")
    assert "Union" not in text and text.count("Exchange hashpartitioning(shop") == 2  # the sizes, and the meetings of blocks


def _made(df, keys):
    """Shuffles by ``keys`` that were made, not reused, when ``df`` was collected."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    by = ", ".join(f"{k}#\\d+" for k in keys)
    return sum(bool(re.search(rf"\+- Exchange hashpartitioning\({by}, \d+\)", line)) and "ShuffleQueryStage" in before
               for before, line in zip(lines, lines[1:]))


def _small_fact(spark):
    rng = random.Random(3)
    rows = [(f"n{rng.randrange(60)}", f"2000-0{rng.randrange(1, 9)}-11", rng.choice([None, "c1", "c2", "c3"]),
             rng.choice([None, *[f"i{k}" for k in range(9)]]), rng.choice([None, "d", "e"]), 2.5) for _ in range(400)]
    return rows, spark.createDataFrame(
        [(*r, "INV", 0, 0) for r in rows], "invoice_number string, invoice_date string, customer_code string, item_code string, "
        "item_description string, line_total double, document_type string, is_sample int, is_return int")


def test_lift_of_null_items_and_customers_with_one_shuffle_of_the_baskets(spark):
    from pricelens.operators import extended
    from pricelens.plans.registry import WHOLE
    rows, fact = _small_fact(spark)
    baskets, lines = {}, Counter(r[3] for r in rows)
    for r in rows:
        baskets.setdefault((r[0], r[2]), set()).add(r[3])
    both, n, buyers = {}, Counter(), {}
    for basket, items in baskets.items():
        for i in items:
            n[i] += 1
            buyers.setdefault(i, set()).add(basket[1])
        for p in combinations(sorted(i for i in items if i), 2):
            both.setdefault(p, []).append(basket[1])
    want = {(a, b): (len(c), len(set(c)), len(c) / lines[a] * 100, len(set(c)) / len(buyers[a]) * 100,
                     len(c) * len(baskets) / (n[a] * n[b])) for (a, b), c in both.items() if len(c) >= 3}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = extended.cross_sell_lift(fact, WHOLE, 3)
        got = {(r[0], r[2]): tuple(r)[4:] for r in found.collect()}
        assert want and got == want
        assert _made(found, ["invoice_number", "customer_code", "item_code"]) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("block, stripes", [(1024, 50_000), (8, 5), (40, 5)])
def test_related_numbers_are_shuffled_instead_of_the_carried_columns(spark, block, stripes):
    rows, day = _table(spark, _groups())
    least = 3
    conditions = {"up": lambda a, b: F.col(f"{a}_day") < F.col(f"{b}_day"), "down": lambda a, b: F.col(f"{b}_day") < F.col(f"{a}_day")}
    want = pair_sums(rows, ["shop"], "n", conditions, least, ["day"], block, stripes).named("a", "b", {"up": "down"})
    relate = lambda a, b: F.when(a["day"] < b["day"], 1).when(b["day"] < a["day"], 2).otherwise(0)
    found = pair_sums(rows, ["shop"], "n", {"up": 1, "down": 2}, least, ["day"], block, stripes, relate)
    assert sorted(map(tuple, found.named("a", "b", {"up": "down"}).collect())) == sorted(map(tuple, want.collect())) != []
    assert "_y__related" in plan(found.counts, "simple") and "_y_day" not in plan(found.counts, "simple")


def test_switching_reads_lines_of_the_pairs_for_trends_and_shuffles_customers_once(spark, monkeypatch):
    from pricelens.operators import extended
    from pricelens.plans.registry import WHOLE
    _, fact = _small_fact(spark)
    made = []
    kept = extended.written_once
    monkeypatch.setattr(extended, "written_once", lambda df, name: (made.append(df), kept(df, name))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = extended.cannibalisation_switching(fact, WHOLE, 3)
        assert "LeftSemi" in plan(found, "simple") and (rows := sorted(map(str, found.collect())))
        made[0].collect()
        assert _made(made[0], ["customer_code", "item_code"]) == 1
        monkeypatch.setattr(extended, "FEW", 0)  # more items than may be sent to every task: all lines are read
        whole = extended.cannibalisation_switching(fact, WHOLE, 3)
        assert "LeftSemi" not in plan(whole, "simple") and sorted(map(str, whole.collect())) == rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("least", [2, 3, 4, 5, 8])
def test_pairs_that_are_not_repeated_enough_do_not_become_rows(spark, least):
    from pricelens.operators.pairs import _SHIFT, _repeated
    rng = random.Random(least)
    rows = [(a, 0, [y - _SHIFT for y in sorted(rng.sample([1, 2, 3, 2**31, 2**32 - 2, 2**32, *range(100, 130)], 6))],
             [rng.randrange(3) for _ in range(6)]) for a in (5, 2**32) for _ in range(8 * least)]
    there = Counter((a, y + _SHIFT) for a, _, ys, _ in rows for y in ys)
    with_numbers = Counter((a, y + _SHIFT, r) for a, _, ys, rs in rows for y, r in zip(ys, rs))
    stripes = spark.createDataFrame(rows, "_a bigint, _split int, _y__id array<int>, _y__related array<tinyint>")
    got = Counter((r["_a"], r["_b"], r["_related"]) for r in _repeated(stripes, least, True).collect())
    enough = {p for p, n in there.items() if n >= least}
    assert enough and {k: n for k, n in got.items() if k[:2] in enough} == {k: n for k, n in with_numbers.items() if k[:2] in enough}
    assert all(there[k[:2]] > least // 2 for k in got)
    plain = Counter((r["_a"], r["_b"]) for r in _repeated(stripes, least, False).collect())
    assert {p: plain[p] for p in enough} == {p: there[p] for p in enough}


def test_stripes_of_a_hot_item_go_to_the_ranges_of_their_items_only(spark):
    rows = spark.range(60).select(F.col("id").alias("shop"), F.explode(F.array(
        F.lit("hot"), F.format_string("i%d", "id"), F.format_string("j%d", F.col("id") % 7))).alias("item_code"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = pair_counts(rows, ["shop"], [F.count(F.lit(1)).alias("n")], stripes=2)  # "hot" has 30 ranges
        want = Counter(p for k in range(60) for p in combinations(sorted(["hot", f"i{k}", f"j{k % 7}"]), 2))
        assert {(r[0], r[1]): r[2] for r in found.named("a", "b").collect()} == want
        found.counts.collect()
        plans, sent = [found.counts._jdf.queryExecution().executedPlan()], []
        while plans:  # the rows that the shuffle of the stripes wrote
            p = plans.pop()
            if p.nodeName() == "Exchange" and "REPARTITION_BY_NUM" in p.simpleString(1000):
                sent.append(p.metrics().apply("shuffleRecordsWritten").value())
            for child in ("executedPlan", "plan"):
                if p.nodeName() == "AdaptiveSparkPlan" and child == "executedPlan" or "QueryStage" in p.nodeName() and child == "plan":
                    plans.append(getattr(p, child)())
            plans += [p.children().apply(i) for i in range(p.children().size())]
        assert len(sent) == 1 and sent[0] <= 60 * 3  # a pair is sent at most once
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
