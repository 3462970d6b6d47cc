"""Small tables with every awkward case, and plain-Python versions of what operators compute."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Names that operators use inside themselves.
CLASHING = ("node", "mark", "score", "n_words", "bucket", "text_hash", "_row", "slot", "group", "url_key")


def words(text: str | None) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def documents(spark: SparkSession, rows: list[tuple]):
    """(doc_id, text[, lang, source]) rows with the columns of documents and clashing extra ones."""
    full = []
    for r in rows:
        doc, text, lang, source = (*r, *(None,) * (4 - len(r)))
        full.append((doc, text, lang, source, len(text) if text is not None else None, *range(len(CLASHING))))
    extra = ", ".join(f"`{c}` int" for c in CLASHING)
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))

AWKWARD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "  \n\t .,!", "en", "a"), (4, "One", "en", None),
    (5, "same text of a few words here", "en", "a"), (6, "same text of a few words here", "de", "b"),
    (6, "same text of a few words here", "de", "b"), (7, LONG, "en", "a"), (8, LONG + " tail", "en", "b"),
    (9, "Größe ß – naïve Ça ÄÖ 東京 \U0001F600 ok", "de", "b"), (None, "no id at all but some words in it", "fr", "a"),
    (10, "same text, of a few WORDS here!", None, "c"), (6, "another text under a known id", "en", "a"),
]
