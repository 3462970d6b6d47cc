import random
from collections import Counter

import numpy as np
import pytest

from pricelens.llm import jaccard
from .helpers import AWKWARD, documents, words


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(doc, class, links) of every row by comparing all pairs."""
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    head = {}
    for i, r in enumerate(rows):
        head.setdefault(root(i), []).append((r[0] is not None, r[0] or 0))
    return sorted((r[0] is not None, r[0] or 0, *min(head[root(i)]), links[i]) for i, r in enumerate(rows))


def found(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["class_id"] is not None, r["class_id"] or 0, r["n_links"])
                  for r in df.collect())


def _rows():
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows = [r for r in AWKWARD]
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    for d in range(1000, 1060):  # other texts that share a passage
        rows.append((d, shared + " " + " ".join(rng.choice(vocabulary) for _ in range(80))))
    base = [rng.choice(vocabulary) for _ in range(150)]
    for d in range(2000, 2070):  # a hot group of near copies
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append((d, " ".join(copy)))
    for d in range(3000, 3030):  # exact copies but for case and marks
        rows.append((d, ", ".join(base[:40]).upper() if d % 2 else " ".join(base[:40])))
    for d in range(4000, 4020):  # short texts
        rows.append((d, " ".join(base[:rng.randrange(1, 9)])))
    return rows


@pytest.mark.parametrize("block_nodes", [2048, 16])
def test_classes_and_links_equal_all_pairs(spark, block_nodes):
    rows = _rows()
    assert found(jaccard.classes(documents(spark, rows), block_nodes=block_nodes)) == brute(rows)


def test_one_row_stays_of_each_class(spark):
    docs = documents(spark, AWKWARD)
    kept = jaccard.one_per_class(docs)
    assert kept.columns == docs.columns
    # 5, 6, 6 and 10 have equal sets; 7 and 8 are near copies; word-less rows stay
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:12]) for r in kept.collect()) == sorted(
        [(1, ""), (2, ""), (3, "  \n\t .,!"), (4, "One"), (5, "same text of"), (7, "word0 and0 w"),
         (9, AWKWARD[9][1][:12]), (0, "no id at all"), (6, "another text")])


def test_empty_table(spark):
    assert jaccard.classes(documents(spark, [])).count() == 0


def test_prefixes_are_shortened_by_the_measured_candidates_until_the_recall_is_met():
    trees, depth = jaccard.TREES, jaccard.DEPTH
    even = jaccard.shortened(0.8, 0.9999, {})
    assert jaccard.expected_recall(0.8, even) >= 0.9999 and set(even) <= {4, 5, 6}
    hot = {(t, d): 10 ** 9 if t < 3 and d < depth else d for t in range(trees) for d in range(1, depth + 1)}
    depths = jaccard.shortened(0.8, 0.9999, hot)  # shorter prefixes are common in three trees: those stay whole
    assert depths[:3] == [depth] * 3 and jaccard.expected_recall(0.8, depths) >= 0.9999
    assert jaccard.shortened(0.8, 0.5, hot) == [depth] * trees  # whole labels are enough
    longer = [d + (i == depths.index(min(depths))) for i, d in enumerate(depths)]
    assert sum(longer) == sum(depths) + 1


def test_ties_join_exactly_the_nodes_that_share_a_prefix(spark):
    rng = np.random.default_rng(2)
    width = 2 * jaccard.DEPTH
    labels = rng.integers(0, 2, (300, jaccard.TREES * jaccard.DEPTH)).astype(">u2")
    labels[100:200] = labels[0]  # a hot label
    names = [i.to_bytes(2, "big") for i in range(300)]
    nodes = spark.createDataFrame([(names[i], labels[i].tobytes()) for i in range(300)], "node binary, labels binary")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # runs are cut by many borders
    try:
        ties, depths = jaccard.forest(nodes, 0.8, 0.9999)
        parent = {n: n for n in names}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for r in ties.collect():
            parent[root(bytes(r["u"]))] = root(bytes(r["v"]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {n: n for n in names}

    def top(x):
        while want[x] != x:
            x = want[x]
        return x
    for t, d in enumerate(depths):
        first = {}
        for i, n in enumerate(names):
            key = labels[i].tobytes()[t * width:t * width + 2 * d]
            want[top(n)] = top(first.setdefault(key, n))
    groups = lambda f: sorted(map(sorted, {r: [n for n in names if f(n) == r] for r in map(f, names)}.values()))
    assert groups(root) == groups(top)


def test_recall_by_similarity(spark):
    """Pairs just above the threshold and well above it, each pair on its own."""
    rng = random.Random(21)
    rows, bands = [], {}
    for k in range(300):
        base = [f"p{k}w{i}" for i in range(200)]
        copy = list(base)
        for at in rng.sample(range(0, 200, 12), rng.randrange(1, 5)):  # each changes five shingles
            copy[at] = f"x{k}at{at}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        bands[k] = len(a & b) / len(a | b)
    got = {r["doc_id"]: r["class_id"] for r in jaccard.classes(documents(spark, rows)).collect()}
    linked = {k: got[2 * k] == got[2 * k + 1] for k in bands}
    assert all(linked[k] == (s >= 0.8) for k, s in bands.items()) and sum(0.8 <= s < 0.85 for s in bands.values()) > 20
