import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricelens.llm import queries, spelling
from .helpers import AWKWARD, SF, documents


def one_edit(a, b):
    """Whether one inserted, deleted or replaced letter turns a into b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else (a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:])


def counted(rows):
    """The damaged words of (doc_id, text) rows."""
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def brute(words):
    """(word, form, root, n, n_near, form_n) by comparing all words; candidates share a deletion."""
    by = {}
    for w in words:
        for p in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            by.setdefault(p, set()).add(w)
    near = {w: {x for p in {w} | {w[:i] + w[i + 1:] for i in range(len(w))} for x in by[p] if one_edit(w, x)} for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words)


def rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def table(spark, words):
    return spark.createDataFrame([(w, n, "extra") for w, n in words.items()], "word string, n long, bucket string")


WORDS = st.text(alphabet="abß", min_size=1, max_size=7)


@settings(max_examples=200, deadline=None)
@given(st.lists(WORDS, unique=True, min_size=1, max_size=60), WORDS)
def test_index_finds_what_one_edit_makes(words, word):
    index = spelling.PositionIndex(words)
    got = [{words[k] for k in index.rows(bits)} for bits in index.near(word, (1 << len(words)) - 1)]
    want = {w for w in words if one_edit(word, w)}
    assert got == [{w for w in want if len(w) == len(word) + d} for d in (0, 1, -1)]


@pytest.mark.parametrize("block", [spelling.BLOCK, 16])
def test_variants_equal_all_pairs(spark, block):
    rng = random.Random(4)
    words = {}
    for _ in range(400):  # short words of few letters: many near words, hot halves
        words["".join(rng.choice("abc") for _ in range(rng.randrange(5, 8)))] = rng.choice([3, 4, 8, 16, 40, 90])
    long = "x" * 500
    words |= {long: 9, long + "y": 3, long[:499]: 20, long[:250] + "z" + long[251:]: 4, "größe": 10, "grösse": 3, "große": 30,
              "grosse": 7, "aaaaa": 100, "aaaab": 40, "aaabb": 20, "aabbb": 10, "abbbb": 5}
    assert rows(spelling.variants(table(spark, words), block=block)) == brute(words)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute(counted(map(tuple, docs)))
    got = rows(queries.spelling_variants(spark, SF))
    assert got == want and any(r[1] for r in got) and any(r[1] != r[2] for r in got if r[1])


def test_awkward_rows(spark):
    docs = documents(spark, [r for r in AWKWARD if r[0] != 7])
    runs = spelling.runs(docs)
    got = {r["word"]: r["n"] for r in spelling.vocabulary(runs.select(spelling.damaged(runs).alias("word"))).collect()}
    assert got == counted([(r[0], r[1]) for r in AWKWARD if r[0] != 7]) and "words" in got
    assert spelling.variants(spelling.vocabulary(spelling.runs(documents(spark, [])).select("run").toDF("word"))).count() == 0
