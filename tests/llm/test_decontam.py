import random

import pytest

from pricelens.llm import decontam
from .helpers import AWKWARD, LONG, documents, words


def brute(text, items, window=13):
    w = words(text)
    hit, found = set(), set()
    for item, body in items:
        iw = words(body)
        k = min(window, len(iw))
        windows = {tuple(iw[s:s + k]) for s in range(len(iw) - k + 1)} if k else set()
        for s in range(len(w) - k + 1 if k else 0):
            if tuple(w[s:s + k]) in windows:
                hit.update(range(s, s + k))
                found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def judged(rows):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"])
                  for r in rows)


def expected(rows, items):
    out = []
    for doc, text, *_ in rows:
        n, h, found, bad = brute(text, items)
        out.append((doc is not None, doc or 0, n, h, tuple(found), bad))
    return sorted(out)


def _case(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["the"] * 10
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([1, 2, 3, 5, 13, 14, 30])))) for i in range(25)]
    items += [(100, items[3][1]), (101, None), (102, "..."), (103, "the the " * 9), (104, "One")]
    rows = list(AWKWARD)
    for d in range(200, 290):
        body = some(rng.randrange(0, 120))
        if d % 3 == 0:
            at = rng.randrange(len(body) + 1)
            body[at:at] = rng.choice(items)[1].split() if rng.random() < .8 else []
        rows.append((d, ", ".join(body).upper()))
    rows += [(300, "the " * 5000), (301, LONG + " " + items[6][1])]
    return rows, [(i, t) for i, t in items]


@pytest.mark.parametrize("block_words", [2_000_000, 60])
def test_scan_equals_brute_force_for_any_number_of_blocks(spark, block_words):
    rows, items = _case()
    docs = documents(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    got = decontam.scan(docs, bench, block_words=block_words).collect()
    assert judged(got) == expected(rows, items)
    kept = decontam.decontaminate(docs, bench, block_words=block_words)
    assert kept.columns == docs.columns
    clean = sorted(str((d, t)) for d, t, *_ in rows if not brute(t, items)[3])
    assert sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == clean


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark, AWKWARD)
    got = decontam.scan(docs, none).collect()
    assert len(got) == len(AWKWARD) and not any(r["n_hit"] or r["contaminated"] for r in got)
    assert decontam.scan(docs.limit(0), none).count() == 0
    assert decontam.decontaminate(docs, none).count() == len(AWKWARD)


def test_prefix_is_the_rarest_shingle():
    words_ = b"a b c d e f g h i j k l m"
    marks = decontam._shingles_of(decontam._windows([(1, words_)], 13), 3)
    counts = {int(m): 10 for m in marks}
    rare = int(marks[4])
    counts[rare] = 1
    assert int(decontam.build_index([(1, words_)], counts).prefix[0]) == rare
