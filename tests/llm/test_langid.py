import zlib

import numpy as np
from pyspark.sql import functions as F

from pricelens.llm import langid, queries
from .helpers import AWKWARD, LONG, documents


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.bayes_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where(
        "held_out and lang is not null").collect()
    assert rows and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def bucket(gram):
    """The feature of one n-gram, by whole numbers."""
    code = 0
    for c in gram:
        code = (code * 0x01000193 + ord(c)) % 2**32
    mixed = (code + len(gram)) * 0x9E3779B1 % 2**32
    return (mixed ^ mixed >> 15) % langid.BUCKETS


def plain_features(text):
    """Buckets of all n-grams of characters, one by one."""
    kept = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text or "")
    kept = f" {' '.join(x for x in kept.split(' ') if x)} "
    return [bucket(kept[i:i + n]) for n in (1, 2, 3) for i in range(len(kept) - n + 1)]


def plain(rows):
    """Counts of n-grams by language, one text after the other."""
    out = {}
    for _, text, lang, _ in rows:
        if lang is not None:
            out.setdefault(lang, np.zeros(langid.BUCKETS))
            np.add.at(out[lang], plain_features(text), 1)
    return out


def plain_prediction(counts, texts, text):
    """Language and score of one text from counts and numbers of texts by language."""
    names = sorted(counts)
    f = plain_features(text)
    log = {x: np.log(counts[x] + langid.SMOOTHING) - np.log((counts[x] + langid.SMOOTHING).sum()) for x in names}
    prior = {x: np.log((texts[x] + 1) / (sum(texts.values()) + len(names))) for x in names}
    best = max(names, key=lambda x: prior[x] + log[x][f].sum())
    z = np.array([prior[x] + log[x][f].sum() * min(langid.EVIDENCE, len(f)) / len(f) for x in names])
    return best, np.exp(z[names.index(best)] - z.max()) / np.exp(z - z.max()).sum()


def test_features_are_those_of_characters():
    for text in ("", "a", "Ab, c-d 1é", "東京 Größe\x00x", LONG[:400], "ÄÖ\U0001F600"):
        assert sorted(langid.features(text.encode())) == sorted(plain_features(text))


def test_predictions_equal_plain_ones(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    counts, texts = plain([r for r in rows if r["doc_id"] % 3]), {}
    for r in rows:
        if r["doc_id"] % 3 and r["lang"] is not None:
            texts[r["lang"]] = texts.get(r["lang"], 0) + 1
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string")
    for columns in (langid.COLUMNS, 1):  # a block of one language each gives the same
        monkeypatch.setattr(langid, "COLUMNS", columns)
        model = langid.fit(docs, F.col("doc_id") % 3 != 0)
        assert len(model.more) == (len(texts) - 1 if columns == 1 else 0)
        got = langid.predictions(model, [(r["text"] or "").encode() for r in rows])
        for r, (lang, score) in list(zip(rows, got))[::7]:
            if lang != "und":
                want = plain_prediction(counts, texts, r["text"])
                assert lang == want[0] and abs(score - want[1]) < 1e-3


def test_a_rare_language_close_to_a_frequent_one_is_found(spark):
    """Two languages of the same words but for their shares, prior 1,000,000 to 1, long texts."""
    rng = np.random.default_rng(5)
    words = np.array([f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)])
    share = {"big": np.linspace(1, 2, 60), "rare": np.linspace(2, 1, 60)}
    text = lambda lang: " ".join(rng.choice(words, 2000, p=share[lang] / share[lang].sum()))
    counts = {x: np.zeros(langid.BUCKETS) for x in share}
    for lang in share:
        for _ in range(20):
            np.add.at(counts[lang], langid.features(text(lang).encode()), 1)
    log = np.stack([np.log(counts[x] + 0.5) - np.log((counts[x] + 0.5).sum()) for x in sorted(share)], 1).astype(np.float32)
    model = langid.Model(("big", "rare"), log, (), np.log(np.array([1e6, 1]) / (1e6 + 1)))
    got = langid.predictions(model, [text("rare").encode() for _ in range(20)])
    assert [g[0] for g in got] == ["rare"] * 20 and all(0 <= g[1] <= 1 for g in got)


def test_model_equals_plain_counts_and_awkward_rows_have_a_result(spark):
    docs = documents(spark, AWKWARD)
    model = langid.fit(docs)
    counts = plain(AWKWARD)
    assert model.languages == tuple(sorted(counts))
    for i, lang in enumerate(model.languages):
        want = np.log(counts[lang] + langid.SMOOTHING) - np.log((counts[lang] + langid.SMOOTHING).sum())
        assert np.allclose(model.first[:, i], want, atol=1e-4)
    got = langid.predict(docs, model).collect()
    assert len(got) == len(AWKWARD)
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (1, 2, 3)} == {("und", 0.0)}
    assert all(r["lang_pred"] in model.languages for r in got if r["doc_id"] not in (1, 2, 3))
    nothing = langid.fit(docs, F.lit(False))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_slices_of_a_long_text_give_all_ngrams(monkeypatch):
    text = LONG[:5000].encode()
    want = np.sort(langid.features(text))
    for size in (64, 1, 4999):
        monkeypatch.setattr(langid, "SLICE", size)
        assert np.array_equal(np.sort(langid.features(text)), want)


def test_letters():
    assert langid.has_letter(b"1 a") and langid.has_letter("東".encode()) and langid.has_letter("é".encode())
    assert not langid.has_letter("123 – …\U0001F600".encode())
