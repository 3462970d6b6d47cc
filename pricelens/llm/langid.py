"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text's ASCII letters are lower-cased and its runs of other ASCII characters become one space; the
n-grams of ``GRAMS`` characters (code points) are hashed to ``BUCKETS`` features.  Training counts the features
of each language in the tasks and sums the counts in the cluster.  The smoothed log-probabilities are a matrix
(``BUCKETS`` x languages floats), kept in blocks of ``COLUMNS`` languages: the first block is broadcast with the tasks, the
others are files in the shared folder which a task opens one at a time, so any number of languages is scored exactly and
no task or driver holds more than a block (32 MB).

Scoring takes texts in groups of about ``GROUP`` characters: the n-grams of a group are the entries of a sparse
matrix (text x feature), whose product with a block is a gather of its rows and a sum over each text's segment.

The language is the one of the largest posterior with all of the text's evidence.  The score is the posterior
of that language with the evidence tempered to ``EVIDENCE`` n-grams, since neighbouring n-grams are not independent.

Cases: a null text and a text without a letter are ``und`` with score 0; null languages are
not learned; without anything learned every text is ``und``; ties go to the first
language by name; long texts are read in slices of ``SLICE`` characters; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

GRAMS, BUCKETS, SLICE, GROUP = (1, 2, 3), 1 << 15, 1 << 18, 1 << 18
SMOOTHING, EVIDENCE, COLUMNS, UNKNOWN = 0.5, 60.0, 256, "und"

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ASCII_LETTERS = bytes(c for c in range(256) if 97 <= c <= 122)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    first: np.ndarray        # [bucket, language], float32: the log-probabilities of the first block
    more: tuple[str, ...]    # files of the other blocks
    prior: np.ndarray        # [language]

    def blocks(self) -> Iterator[np.ndarray]:
        yield self.first
        for path in self.more:
            yield _load(path)


@lru_cache(maxsize=1)
def _load(path: str) -> np.ndarray:
    fs, name = common.open_filesystem(path)
    with fs.open_input_file(name) as f:
        return np.frombuffer(f.read(), np.float32).reshape(BUCKETS, -1)


def _folded(text: bytes | None) -> str:
    return " " + b" ".join((text or b"").translate(_LETTERS).split()).decode("utf-8", "replace") + " "


def _hashed(pieces: list[tuple[int, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the n-grams of (text, characters, how many of them begin an n-gram of this piece), by text."""
    sizes = np.array([len(p) for _, p, _ in pieces])
    codes = np.frombuffer("".join(p for _, p, _ in pieces).encode("utf-32-le", "surrogatepass"), "<u4")
    piece = np.repeat(np.arange(len(pieces)), sizes)
    inside = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    begins = inside < np.repeat([n for _, _, n in pieces], sizes)
    text = np.array([t for t, _, _ in pieces])[piece]
    owners, buckets, code = [], [], np.zeros(len(codes), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(codes) < n:
            break
        code = code[:len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1:]
        if n in GRAMS:
            whole = begins[:len(code)] & (piece[:len(code)] == piece[n - 1:])
            mixed = (code[whole] + np.uint32(n)) * np.uint32(0x9E3779B1)
            owners.append(text[:len(code)][whole])
            buckets.append((mixed ^ (mixed >> np.uint32(15))) % np.uint32(BUCKETS))
    return np.concatenate(owners), np.concatenate(buckets)


def grams(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of all n-grams with repetition, in groups of bounded size."""
    held, size, reach = [], 0, max(GRAMS) - 1
    for i, text in enumerate(texts):
        folded = _folded(text)
        for at in range(0, len(folded), SLICE):
            held.append((i, folded[at:at + SLICE + reach], SLICE))
            size += len(held[-1][1])
            if size >= GROUP:
                yield _hashed(held)
                held, size = [], 0
    if held:
        yield _hashed(held)


def features(text: bytes) -> np.ndarray:
    """Hashed n-grams of a text, with repetition."""
    return np.concatenate([b for _, b in grams([text])])


def has_letter(text: bytes) -> bool:
    """Whether any character is a letter (of any script)."""
    ascii_only = text.translate(_LETTERS)
    if len(ascii_only.translate(None, _ASCII_LETTERS)) < len(ascii_only):
        return True
    return not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace")))


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}

    def made() -> pa.RecordBatch:
        names = list(total)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([texts[x] for x in names], pa.int64()),
             pa.array([total[x] for x in names], pa.list_(pa.int64()))], ["lang", "texts", "counts"])

    for batch in batches:
        langs, raw = batch.column(0).to_pylist(), common.utf8(batch.column(1))
        by: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            by.setdefault(lang, []).append(i)
        for lang, rows in by.items():
            if lang not in total:
                if len(total) >= COLUMNS:
                    yield made()
                    total.clear()
                    texts.clear()
                total[lang] = np.zeros(BUCKETS, np.int64)
            texts[lang] = texts.get(lang, 0) + len(rows)
            for _, buckets in grams([raw[i] for i in rows]):
                total[lang] += np.bincount(buckets, minlength=BUCKETS)
    yield made()


def fit(documents: DataFrame, learn: Column | None = None) -> Model:
    """Learn from every row with a language (and, if given, the condition ``learn``)."""
    rows = documents if learn is None else documents.where(learn)
    rows = rows.select(rows["lang"], rows["text"]).where("lang is not null")
    parts = rows.mapInArrow(_count_task, "lang string, texts long, counts array<bigint>")
    # summed by bucket in the cluster
    cells = parts.select("lang", "texts", F.posexplode("counts").alias("bucket", "n")).where("n > 0 or bucket = 0")
    cells = common.written(cells.groupBy("lang", "bucket").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")),
                           "langid-cells")
    texts = {r["lang"]: r["texts"] for r in cells.where("bucket = 0").select("lang", "texts").collect()}
    names, blocks = tuple(sorted(texts)), []
    for at in range(0, len(names), COLUMNS):  # the driver holds one block of the matrix at a time
        column = {x: i for i, x in enumerate(names[at:at + COLUMNS])}
        counts = np.full((BUCKETS, len(column)), SMOOTHING)
        for lang, bucket, n in cells.where(F.col("lang").between(names[at], max(column))).select("lang", "bucket", "n").collect():
            counts[bucket, column[lang]] += n
        log = (np.log(counts) - np.log(counts.sum(axis=0, keepdims=True))).astype(np.float32)
        if not at:
            first = log
            continue
        path = common.shared_folder(documents.sparkSession, "langid-block")
        fs, name = common.open_filesystem(path)
        with fs.open_output_stream(name) as f:
            f.write(log.tobytes())
        blocks.append(path)
    many = np.array([texts[x] for x in names], np.float64)
    prior = np.log((many + 1) / (many.sum() + len(names))) if names else many
    return Model(names, first if names else np.zeros((BUCKETS, 0), np.float32), tuple(blocks), prior)


def predictions(model: Model, texts: list[bytes | None]) -> list[tuple[str, float]]:
    """Language and score of every text."""
    out = [(UNKNOWN, 0.0)] * len(texts)
    asked = [i for i, t in enumerate(texts) if t and has_letter(t)] if model.languages else []
    evidence, total = np.zeros((len(asked), len(model.languages))), np.zeros(len(asked))
    for text, bucket in grams([texts[i] for i in asked]):
        at = np.argsort(text, kind="stable")
        text, bucket = text[at], bucket[at]
        starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        rows, column = text[starts], 0
        total[rows] += np.diff(np.r_[starts, len(text)])
        for block in model.blocks():
            evidence[rows, column:column + block.shape[1]] += np.add.reduceat(block[bucket], starts, axis=0, dtype=np.float64)
            column += block.shape[1]
    best = np.argmax(model.prior + evidence, axis=1) if asked else []
    for k, i in enumerate(asked):
        z = model.prior + evidence[k] * (min(EVIDENCE, total[k]) / total[k])
        top = z.max()
        out[i] = model.languages[best[k]], float(np.exp(z[best[k]] - top) / np.exp(z - top).sum())
    return out


def _predict_task(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 512
        for batch in batches:
            raw = common.utf8(batch.column(1))
            found = [x for at in range(0, len(raw), step) for x in predictions(model, raw[at:at + step])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])
    return predict


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    docs = documents.select(documents["doc_id"], documents["text"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_predict_task(model), f"doc_id {kind}, lang_pred string, score double")
