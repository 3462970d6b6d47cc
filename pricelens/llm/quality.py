"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on text labelled good and one on text
labelled bad.  A text is cut into blocks of ``BLOCK`` bytes and every block is compressed
with both dictionaries; the normalised difference of the sizes,
``(with bad - with good) / (with bad + with good + SHRINK)`` over all blocks, says which kind of
text it is more like.  Text that repeats itself compresses equally well with either, so
the size without a dictionary, over the text's bytes and at most ``PLAIN``, is the second
input.  A logistic curve fitted on labelled texts that the dictionaries have not seen,
weighted as the labels are spread, turns both into the probability of label 1.

Training reads a bounded sample of the labelled rows: at most ``per_class`` texts of each
label, taken in the order of the MD5 of their doc_id, and of texts up to ``max_chars``
characters.  Half of it builds the dictionaries, the other half fits the curve.  Scoring
reads every whole text; blocks bound the memory for very long ones.

Cases: null and empty texts have the difference 0 and so a score of their own, the same
for all; rows with a null or contradictory label are not learned from; with too little
text for a dictionary the raw text serves as one; without any label every score is 0.5;
repeated rows get equal scores; extra columns are ignored by ``score`` and kept by
``keep_good``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK, LEVEL, DICTIONARY_BYTES, PLAIN = 4096, 3, 112 * 1024, 0.35
#: Added to the sizes of both, so that a few bytes say little.
SHRINK = 60
PER_CLASS, MAX_CHARS, THRESHOLD = 2000, 20_000, 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]  # of the difference, the plain size and 1


class Scorer:
    """Scores texts with a model; made once in each task."""

    def __init__(self, model: Model):
        self.model = model
        self.compressors = []
        for raw in (model.good, model.bad, b""):
            d = zstandard.ZstdCompressionDict(raw) if raw else None
            if d:
                d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: bytes | None) -> tuple[float, float]:
        """The normalised difference, and the plain size over the text's bytes."""
        good = bad = plain = 0
        by_good, by_bad, by_none = (c.compress for c in self.compressors)
        view = memoryview(text or b"")
        for at in range(0, len(view), BLOCK):
            block = view[at:at + BLOCK]
            good += len(by_good(block))
            bad += len(by_bad(block))
            plain += len(by_none(block))
        return ((bad - good) / (bad + good + SHRINK), min(PLAIN, plain / len(view))) if good else (0.0, PLAIN)

    def score(self, text: bytes | None) -> float:
        difference, plain = self.sizes(text)
        u, v, w = self.model.weights
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, u * difference + v * plain + w))))


def _dictionary(texts: list[bytes]) -> bytes:
    blocks = [t[i:i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on
        return b"".join(texts)[-DICTIONARY_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of P(y = 1) by Newton steps, with a slight pull towards 0; the last is the constant."""
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) + 1e-2 * w
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    inner = w[:-1] / scale
    return np.append(inner, w[-1] - inner @ centre)


def train(rows: list[tuple[bytes, int]], spread: dict[int, int] | None = None) -> Model:
    """A model of (text, label) rows; every second row of a label fits the curve.

    ``spread``: how many labelled rows there are of each label, where ``rows`` is a sample."""
    by = {k: [t for t, q in rows if q == k] for k in (0, 1)}
    if not by[0] or not by[1]:
        return Model(b"", b"", (0.0, 0.0, 0.0))
    seen = Model(_dictionary(by[1][::2]), _dictionary(by[0][::2]), (0.0, 0.0, 0.0))
    scorer = Scorer(seen)
    rest = {k: by[k][1::2] or by[k] for k in (0, 1)}
    x = np.array([scorer.sizes(t) for k in (0, 1) for t in rest[k]])
    y = np.array([k for k in (0, 1) for _ in rest[k]], float)
    spread = spread or {k: len(by[k]) for k in (0, 1)}
    each = {k: spread[k] / len(rest[k]) for k in (0, 1)}
    weight = np.where(y == 1, each[1], each[0])
    fitted = _logistic(x, y, weight * len(y) / weight.sum())
    return Model(seen.good, seen.bad, tuple(float(v) for v in fitted))


def labelled(documents: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """doc_id, text, quality of the rows to learn from: one agreed label, not null.

    ``learn``: a condition on the column doc_id."""
    q = labels.select(labels["doc_id"].alias("doc_id"), labels["quality"].alias("quality"))
    q = q.where("quality is not null and doc_id is not null")
    if learn is not None:
        q = q.where(learn)
    q = q.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_other"))
    docs = documents.select(documents["doc_id"].alias("doc_id"), documents["text"].alias("text"))
    return docs.join(q.where("quality = _other").drop("_other"), "doc_id")


def fit(documents: DataFrame, labels: DataFrame, learn: Column | None = None,
        per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """Train on a bounded sample: at most ``2 * per_class`` texts reach the driver."""
    ids = labelled(documents.select("doc_id", F.lit(None).cast("string").alias("text")), labels, learn)
    spread = {r[0]: r[1] for r in ids.where("quality in (0, 1)").groupBy("quality").count().collect()}
    picked = None
    for k in (0, 1):
        some = ids.where(F.col("quality") == k).select("doc_id", "quality").orderBy(
            F.md5(F.col("doc_id").cast("string")), "doc_id").limit(per_class)
        picked = some if picked is None else picked.union(some)
    some = [r[0] for r in picked.collect()]
    docs = documents.select(documents["doc_id"].alias("doc_id"), documents["text"].alias("text"))
    texts = labelled(docs.where(F.col("doc_id").isin(some)), labels, learn).where(
        F.length("text").between(1, max_chars))
    rows = texts.select(F.encode("text", "UTF-8"), "quality", "doc_id").collect()
    rows.sort(key=lambda r: (r[2], bytes(r[0])))
    return train([(bytes(r[0]), r[1]) for r in rows], spread if len(spread) == 2 else None)


def _score_task(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in common.slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([scorer.score(t) for t in common.utf8(batch.column(1))], pa.float64())],
                ["doc_id", "score"])
    return score


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and the probability of label 1 for every row."""
    docs = documents.select(documents["doc_id"], documents["text"])
    return docs.mapInArrow(_score_task(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def _keep_task(model: Model, at: int, threshold: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in common.slices(batches):
            yield batch.filter(pa.array([scorer.score(t) >= threshold for t in common.utf8(batch.column(at))],
                                        pa.bool_()))
    return keep


def keep_good(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score at least ``threshold``, with all their columns, filtered where they are read."""
    return documents.mapInArrow(
        _keep_task(model, documents.columns.index("text"), threshold), documents.schema)
