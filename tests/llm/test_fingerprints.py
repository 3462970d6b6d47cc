import hashlib
import random

from pyspark.sql import functions as F

from pricelens.llm import fingerprints, queries
from .helpers import AWKWARD, SF, documents


def identity(text):
    lanes = [0] * fingerprints.IDENTITY
    for p in (text or "").split("\n"):
        d = hashlib.sha256(p.encode()).hexdigest()
        lanes = [(v + int(d[8 * k:8 * k + 8], 16)) % 2**32 for k, v in enumerate(lanes)]
    return "".join(f"{v:08x}" for v in lanes)


def edits(rows):
    """(doc_id, n_chars, sha256 of the edited text) with rows in order of (doc_id), ties left out."""
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        out.append((doc, len(text), hashlib.sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest()))
    return out


def test_edited_texts_and_identity_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 30)  # several buckets, heads sent to the one before
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    assert [(d, got[d]["n_chars"], got[d]["edited_sha256"]) for d, _ in rows] == edits(rows)
    assert all(got[d]["fingerprint"].startswith(identity(t)) for d, t in rows)
    near = [got[d] for d, t in rows if len((t or "").split()) > 30]
    mean = lambda k: sum(r[k] for r in near) / len(near)
    assert mean("near_edited") > 0.5 and mean("near_next") < 0.15
    assert all(0 <= r[k] <= 1 for r in got.values() for k in ("near_edited", "near_next"))


def test_sums_are_homomorphic_and_free_of_order(spark):
    rows = [(1, "a b c d\ne f g\n"), (2, "a b c d"), (3, "e f g\n"), (4, "\ne f g\na b c d"), (5, "a b c d\ne f g")]
    fp = fingerprints.sums(spark.createDataFrame(rows, "id int, text string"), ["id"])
    by = {r["id"]: r for r in fp.collect()}
    assert by[1]["fingerprint"] == by[4]["fingerprint"] != by[5]["fingerprint"]
    pair = spark.createDataFrame([(by[2]["fingerprint"], by[3]["fingerprint"], by[1]["fingerprint"])], "a string, b string, c string")
    both, left, back = pair.select(
        fingerprints.add(F.col("a"), F.col("b")), fingerprints.subtract(F.col("c"), F.col("b")),
        fingerprints.subtract(F.col("c"), F.col("a"))).first()
    assert both == by[1]["fingerprint"] and left == by[2]["fingerprint"] and back == by[3]["fingerprint"]


def test_counts_of_a_very_long_text_are_exact(spark):
    n = 2**21 + 5
    rows = spark.createDataFrame([(1, n), (2, 7)], "id int, n int").selectExpr("id", "trim(repeat('same ', n)) as text")
    both = spark.createDataFrame([(3, n)], "id int, n int").selectExpr(
        "id", "concat(trim(repeat('same ', n)), '\n', trim(repeat('same ', 7))) as text")
    by = {r["id"]: r for r in fingerprints.sums(rows.union(both), ["id"]).collect()}
    assert by[1]["n_words"] > 2**21 and {abs(x) for x in by[1]["lanes"]} == {by[1]["n_words"]}
    pair = spark.createDataFrame([(by[1]["fingerprint"], by[2]["fingerprint"], by[3]["fingerprint"])], "a string, b string, c string")
    total, left = pair.select(fingerprints.add(F.col("a"), F.col("b")), fingerprints.subtract(F.col("c"), F.col("b"))).first()
    assert total == by[3]["fingerprint"] and left == by[1]["fingerprint"]


def test_words_of_any_length_and_script_and_their_order_count(spark):
    rng = random.Random(3)
    short = [x for i in range(100) for x in (str(rng.randrange(90)), f"a{rng.randrange(9)}")]
    han = [chr(0x4E00 + rng.randrange(5000)) for _ in range(200)]
    code = [rng.choice("abcdefghijklmnopqrstuvwxyz0123456789,;") for _ in range(300)]
    half = lambda words: words[:len(words) // 2] + rng.sample(words, len(words) // 2)
    pairs = {
        "short": (" ".join(short), " ".join(half(short)), 0.3), "tabs": ("\t".join(short), "\u3000".join(short), 0.99),
        "han": ("".join(han), "".join(half(han)), 0.3), "unspaced": ("".join(code), "".join(half(code)), 0.3)}
    rows = [(k, t) for name, (a, b, _) in pairs.items() for k, t in ((f"{name}-a", a), (f"{name}-b", b))]
    rows += [("short-shuffled", " ".join(rng.sample(short, len(short))))]
    by = {r["id"]: r for r in fingerprints.sums(spark.createDataFrame(rows, "id string, text string"), ["id"]).collect()}

    def like(a, b):
        x, y = by[a]["lanes"], by[b]["lanes"]
        return sum(p * q for p, q in zip(x, y)) / (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5

    assert by["short-a"]["n_words"] == 198 and by["han-a"]["n_words"] == 198 and by["unspaced-a"]["n_words"] == 298
    for name, (*_, least) in pairs.items():
        assert like(f"{name}-a", f"{name}-b") >= least, name
    assert like("short-a", "short-shuffled") < 0.6


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD)
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(AWKWARD)
    rows = [(str(r["doc_id"]), r["n_chars"]) for r in got]
    assert sorted(rows) == sorted((str(d), len(t or "")) for d, t, *_ in AWKWARD)
    by_text = {}
    for r in got:
        by_text.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    same = {f for (d, n), fs in by_text.items() for f in fs if d in (1, 2)}
    assert len(same) == 1  # null and empty
    assert by_text[(5, 29)] < by_text[(6, 29)]  # equal texts; the other text of 6 is as long
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0
    one = fingerprints.fingerprints(documents(spark, [(7, "only this text")])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == edits([(7, "only this text")])[0][2]


def test_no_python_on_the_main_path(spark):
    plan = queries.multiset_fingerprints(spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    plan = queries.pfair_mix(spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
