import random
import re

import pytest

from pricelens.llm import licenses
from .helpers import AWKWARD, documents, words


def brute(text):
    w = words(text)
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w))
              if w[i:i + len(phrase.split())] == phrase.split()]
    return (len(w), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None),
            ",".join(sorted({x for _, x in places})))


def texts():
    rng = random.Random(3)
    parts = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "CC", "By,", "x", "é", "-", "\n"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", "  ", "-"]) for _ in range(rng.randrange(60)))
            for _ in range(400)] + ["cc by cc by", "CC-BY", "all rights reserved", "accc by", "cc by"]


def test_base_places_equal_brute_force(spark):
    rows = [*AWKWARD, *((1000 + i, t, None, None) for i, t in enumerate(texts()))]
    got = licenses.scan(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    assert sorted((key((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in got)) \
        == sorted(key((d, *brute(t))) for d, t, *_ in rows)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) for r in got)
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) for r in got)
    assert licenses.scan(documents(spark, [])).count() == 0


@pytest.mark.parametrize("text, alternatives", [
    ("MIT", [["mit"]]),
    ("MIT OR Apache-2.0", [["mit"], ["apache-2.0"]]),
    ("MIT AND BSD-3-Clause OR ISC", [["mit", "bsd-3-clause"], ["isc"]]),
    ("MIT AND (BSD-3-Clause OR ISC)", [["mit", "bsd-3-clause"], ["mit", "isc"]]),
    ("GPL-2.0-only WITH Classpath-exception-2.0 or mit", [["gpl-2.0-only-with-classpath-exception-2.0"], ["mit"]]),
    ("MIT AND", [["mit"]]), ("((MIT", [["mit"]]), ("AND MIT", []), ("", []), ("MIT */ more", [["mit"]]),
])
def test_expressions(text, alternatives):
    assert licenses.evaluate(text) == frozenset(map(frozenset, alternatives))


def test_tags_add_labels():
    row = licenses.scan_one(b"x\n# SPDX-License-Identifier: (MIT OR ISC) AND Zlib\nall rights reserved")
    assert row[5] == "isc,mit,reserved,zlib" and row[7] == ["isc and zlib or mit and zlib"]


@pytest.mark.parametrize("tag, label", [("MIT.", "mit"), ("GPL-2.0+.", "gpl-2.0+"), ("Apache-2.0,", "apache-2.0"), ("ISC:", "isc")])
def test_marks_after_a_name_are_not_part_of_it(tag, label):
    assert licenses.scan_one(f"SPDX-License-Identifier: {tag}\nx".encode())[5] == label


def _meets(told, accepted):
    """Whether a told expression is met by the accepted licences, by Python's own operators."""
    return eval(re.sub(r"[^() ]+", lambda m: m[0] if m[0] in ("and", "or") else str(m[0] in accepted), told))  # noqa: S307


def test_many_factors_keep_their_alternatives():
    for n in (3, 7, 8, 30):
        parsed = licenses.parse(" AND ".join(f"(A{i} OR B{i})" for i in range(n)))
        assert parsed.names == {f"{x}{i}" for i in range(n) for x in "ab"}
        assert (parsed.alternatives is None) == (n >= 8) and (n >= 8 or len(parsed.alternatives) == 2 ** n)
        for rest in ([], ["a0"], ["b0"]):
            accepted = {f"{'ab'[i % 2]}{i}" for i in range(1, n)} | set(rest)
            assert _meets(parsed.told(), accepted) == bool(rest)


def test_random_expressions_mean_what_they_say(monkeypatch):
    rng = random.Random(8)

    def made(depth):
        if not depth or rng.random() < 0.2:
            return rng.choice("uvwxyz")
        op = rng.choice([" and ", " or "])
        return "(" + op.join(made(depth - 1) for _ in range(rng.randrange(2, 4))) + ")"

    for limit in (0, 1024):  # told by factors, and by alternatives
        monkeypatch.setattr(licenses, "EXPANDED_NAMES", limit)
        for _ in range(300):
            text, accepted = made(4), set(rng.sample("uvwxyz", 3))
            assert _meets(licenses.parse(text).told(), accepted) == _meets(text, accepted)


def test_long_expressions_are_read_in_one_pass():
    chain = licenses.parse(" OR ".join(f"L{i}" for i in range(30_000)))
    assert len(chain.names) == 30_000
    assert licenses.parse("(" * 20_000 + "MIT" + ")" * 20_000).told() == "mit"
    nested = licenses.parse("".join(f"(A{i} OR (B{i} AND " for i in range(5_000)) + "C" + "))" * 5_000)
    assert len(nested.names) == 10_001 and nested.alternatives is None


def test_labels_and_score_equal_brute_force():
    rng = random.Random(9)
    phrases = {**licenses.BASE, **licenses.FURTHER}
    pieces = [*phrases, *(w for p in phrases for w in p.split()), "SPDX-License-Identifier: Zlib\n", "other", "\n"]
    for _ in range(500):
        text = "".join(rng.choice(pieces) + rng.choice([" ", "\n", "-"]) for _ in range(rng.randrange(12)))
        w, doubt, labels = words(text), 1.0, set()
        for phrase, label in phrases.items():
            n = sum(w[i:i + len(phrase.split())] == phrase.split() for i in range(len(w)))
            labels |= {label} if n else set()
            doubt *= (1 - licenses.WEIGHTS["base" if phrase in licenses.BASE else "further"]) ** n
        if "SPDX-License-Identifier: Zlib\n" in text:
            labels.add("zlib")
            doubt = 0.0
        got = licenses.scan_one(text.encode())
        assert got[5] == ",".join(sorted(labels)) and abs(got[6] - (1 - doubt)) < 1e-9
