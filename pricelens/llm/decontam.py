"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item's windows are its runs of ``window`` consecutive words (an item with
fewer words, but not none, is one window).  A document word is *hit* when it lies inside
an occurrence of any window.  A window can occur only where all of its shingles do, so
for full containment the necessary prefix of its shingle set, ordered by rarity in the
corpus, is the single rarest one.  The join runs in four steps:

1. count every benchmark shingle over all documents (combined in each task);
2. each distinct window keeps its rarest shingle and that shingle's offset: the prefix index;
3. documents look their shingles up in the index; a match at word ``p`` with offset ``o``
   fixes the only possible window start ``p - o``, which the positional bound (start >= 0)
   and the length bound (start + window length <= words of the document) must allow;
4. the surviving candidates are verified word by word over the whole window.

The index is shipped to the tasks in blocks of at most ``block_words`` benchmark words
(the size is counted first); a larger benchmark is joined block by block, and the hit
positions of the blocks are united per document, so no broadcast grows with the data.

Cases: null and word-less texts have no words, no hits and are never contaminated; null
item texts and items without words have no windows; equal items all count (by item_id);
repeated documents give one row each; long texts are read whole, candidates in slices;
an empty benchmark leaves every document clean; extra columns are ignored by ``scan``
and kept by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A document is contaminated when it has a hit for every so many of its words.
WORDS_PER_HIT = 20
WINDOW, SHINGLE, BLOCK_WORDS = 13, 3, 2_000_000
_SLICE = 1 << 18  # candidates verified at once


@dataclass
class Index:
    """The windows of one block of items; arrays are parallel, sorted by prefix shingle."""
    length: np.ndarray    # words of each distinct window
    body: np.ndarray      # [window, words] word hashes, zero-filled
    items: list[list]     # item ids that contain the window
    prefix: np.ndarray    # sorted rarest shingles, one entry a window
    offset: np.ndarray    # where the shingle starts inside its window
    sizes: np.ndarray     # shingle sizes in use
    filter: np.ndarray    # bit table over the low 16 bits of the prefixes


def _windows(items: list[tuple], window: int):
    """Distinct windows (as bytes of their word hashes) and the items that have them."""
    found: dict[bytes, set] = {}
    for item, text in items:
        h = common.word_hashes(text)
        k = min(window, len(h))
        for s in range(len(h) - k + 1 if k else 0):
            found.setdefault(h[s:s + k].tobytes(), set()).add(item)
    return found


def _shingles_of(found, shingle: int) -> np.ndarray:
    parts = [common.shingle_hashes(np.frombuffer(w, np.uint64), shingle) for w in found]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def build_index(items: list[tuple], counts: dict[int, int], window: int = WINDOW,
                shingle: int = SHINGLE) -> Index:
    found = _windows(items, window)
    length, prefix, offset, ids = [], [], [], []
    body = np.zeros((len(found), window), np.uint64)
    for i, (raw, of) in enumerate(found.items()):
        w = np.frombuffer(raw, np.uint64)
        body[i, :len(w)] = w
        marks = common.shingle_hashes(w, shingle)
        best = min(range(len(marks)), key=lambda j: (counts.get(int(marks[j]), 0), int(marks[j]), j))
        length.append(len(w))
        prefix.append(marks[best])
        offset.append(best)
        ids.append(sorted(of, key=str))
    prefix, length = np.array(prefix, np.uint64), np.array(length, np.int64)
    order = np.argsort(prefix, kind="stable")
    return Index(length[order], body[order], [ids[i] for i in order], prefix[order],
                 np.array(offset, np.int64)[order], np.unique(np.minimum(length, shingle)), _bit_table(prefix))


def _bit_table(marks: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 16, bool)
    bits[(marks & np.uint64(0xFFFF)).astype(np.int64)] = True
    return bits


def _positions(marks: np.ndarray, bits: np.ndarray, known: np.ndarray):
    """Positions in ``marks`` that may be in the sorted ``known``, with their range there."""
    at = np.flatnonzero(bits[(marks & np.uint64(0xFFFF)).astype(np.int64)])
    lo = np.searchsorted(known, marks[at], "left")
    n = np.searchsorted(known, marks[at], "right") - lo
    return at[n > 0], lo[n > 0], n[n > 0]


def _starts(index: Index, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) pairs whose prefix shingle stands at the position."""
    at, lo, n = _positions(marks, index.filter, index.prefix)
    first = np.repeat(np.cumsum(n) - n, n)
    return np.repeat(lo, n) + np.arange(n.sum()) - first, np.repeat(at, n)


def match(index: Index, hashes: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, set]:
    """Hit flag of each word, and the windows that occur."""
    n = len(hashes)
    hit, seen = np.zeros(n, bool), set()
    if not n or not len(index.prefix):
        return hit, seen
    edge = np.zeros(n + 1, np.int64)
    # items shorter than a shingle have shingles of their own, shorter size
    for k in index.sizes:
        if n < k:
            continue
        marks = common.shingle_hashes(hashes, int(k))
        for cut in range(0, len(marks), _SLICE):
            window, at = _starts(index, marks[cut:cut + _SLICE])
            for part in range(0, len(window), _SLICE):
                w, p = window[part:part + _SLICE], at[part:part + _SLICE] + cut
                start, size = p - index.offset[w], index.length[w]
                ok = (start >= 0) & (start + size <= n)
                w, start, size = w[ok], start[ok], size[ok]
                span = np.arange(index.body.shape[1])
                inside = span < size[:, None]
                got = hashes[np.minimum(start[:, None] + span, n - 1)]
                ok = ((got == index.body[w]) | ~inside).all(axis=1)
                seen.update(w[ok].tolist())
                np.add.at(edge, start[ok], 1)
                np.add.at(edge, start[ok] + size[ok], -1)
    hit = np.cumsum(edge[:n]) > 0
    return hit, seen


def _count_task(marks: np.ndarray, sizes: tuple[int, ...]):
    bits = _bit_table(marks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(marks), np.int64)
        for batch in common.slices(batches):
            for text in common.utf8(batch.column(0)):
                h = common.word_hashes(text)
                for k in sizes:
                    if len(h) >= k:
                        np.add.at(total, _positions(common.shingle_hashes(h, k), bits, marks)[1], 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(marks[some].view(np.int64)), pa.array(total[some])], ["mark", "n"])
    return count


def _judge(index: Index, shingle: int, text: bytes | None) -> tuple[int, list[int], list[str]]:
    """Words, hit ranges (start, end, start, end, ...) and the items with occurring windows."""
    h = common.word_hashes(text)
    hit, seen = match(index, h, shingle)
    edges = np.flatnonzero(np.diff(hit, prepend=False, append=False)).tolist() if seen else []
    return len(h), edges, sorted({str(x) for w in seen for x in index.items[w]})


def _length(edges: list[int]) -> int:
    return sum(edges[1::2]) - sum(edges[::2])


def _scan_task(index: Index, shingle: int, every: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = [_judge(index, shingle, t) for t in common.utf8(batch.column(2))]
            keep = [i for i, f in enumerate(found) if every or f[1]]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at),
                 pa.array([found[i][0] for i in keep], pa.int64()),
                 pa.array([found[i][1] for i in keep], pa.list_(pa.int64())),
                 pa.array([_length(found[i][1]) for i in keep], pa.int64()),
                 pa.array([found[i][2] for i in keep], pa.list_(pa.string()))],
                ["doc_id", "text_hash", "n_words", "hit_edges", "n_hit", "items"])
    return scan


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite the hit ranges and items that the blocks of items gave for a document."""
    for batch in batches:
        edges, items = [], []
        for lists in batch.column("hit_edges").to_pylist():
            merged: list[int] = []
            for s, e in sorted((s, e) for one in lists for s, e in zip(one[::2], one[1::2])):
                if merged and s <= merged[-1]:
                    merged[-1] = max(merged[-1], e)
                else:
                    merged += [s, e]
            edges.append(merged)
        for lists in batch.column("items").to_pylist():
            items.append(sorted({x for one in lists for x in one}))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(edges, pa.list_(pa.int64())),
             pa.array([_length(e) for e in edges], pa.int64()), pa.array(items, pa.list_(pa.string()))],
            ["doc_id", "text_hash", "n_words", "hit_edges", "n_hit", "items"])


def _item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple]]:
    """Blocks of (item_id, text) with about ``block_words`` words at most, each fetched alone."""
    items = benchmark.select(benchmark["item_id"], F.encode(benchmark["text"], "UTF-8").alias("text"))
    size = items.select(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * block_words)))  # a word and its separator are 2 bytes at least
    for i in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i) if blocks > 1 else items
        yield [(r[0], bytes(r[1])) for r in part.collect() if r[1] is not None]


def _indexes(texts: DataFrame, benchmark: DataFrame, window: int, shingle: int, block_words: int) -> list[Index]:
    """One prefix index a block of items, its shingles ordered by their count in all ``texts``."""
    out = []
    for block in _item_blocks(benchmark, block_words):
        found = _windows(block, window)
        marks, counts = _shingles_of(found, shingle), {}
        if len(marks):
            sizes = tuple(sorted({min(shingle, len(w) // 8) for w in found}))
            # at most one row for each shingle of this block comes back
            counts = {r[0] & 0xFFFFFFFFFFFFFFFF: r[1] for r in texts.mapInArrow(
                _count_task(marks, sizes), "mark long, n long").groupBy("mark").agg(F.sum("n")).collect()}
        out.append(build_index(block, counts, window, shingle))
    return out


def _contaminated(n_hit: int, n_words: int, words_per_hit: int) -> bool:
    return n_hit > 0 and words_per_hit * n_hit >= n_words


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
         block_words: int = BLOCK_WORDS, words_per_hit: int = WORDS_PER_HIT) -> DataFrame:
    """A row for each document: doc_id, text_hash, n_words, hit_edges (word positions: start,
    end, start, end, ... of the hit ranges), n_hit, items (ids as strings, sorted), contaminated."""
    docs = documents.select(documents["doc_id"], F.xxhash64(documents["text"]).alias("text_hash"), documents["text"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, text_hash long, n_words long, hit_edges array<bigint>, n_hit long, "
              "items array<string>")
    first, *rest = [docs.mapInArrow(_scan_task(index, shingle, i == 0), schema) for i, index in
                    enumerate(_indexes(docs.select("text"), benchmark, window, shingle, block_words))]
    if rest:  # only documents with hits come out of the later blocks
        more = rest[0]
        for r in rest[1:]:
            more = more.union(r)
        more = more.distinct().groupBy("doc_id", "text_hash").agg(
            F.collect_list("hit_edges").alias("edges"), F.collect_list("items").alias("ids"))
        same = first["doc_id"].eqNullSafe(more["doc_id"]) & (first["text_hash"] == more["text_hash"])
        none = F.array().cast("array<array<bigint>>"), F.array().cast("array<array<string>>")
        first = first.join(more, same, "left").select(
            first["doc_id"], first["text_hash"], "n_words",
            F.concat(F.array("hit_edges"), F.coalesce("edges", none[0])).alias("hit_edges"),
            "n_hit", F.concat(F.array("items"), F.coalesce("ids", none[1])).alias("items"),
        ).mapInArrow(_unite, schema)
    return first.withColumn("contaminated", (F.col("n_hit") > 0)
                            & (F.lit(words_per_hit) * F.col("n_hit") >= F.col("n_words")))


def _clean_task(index: Index, shingle: int, at: int, words_per_hit: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            judged = (_judge(index, shingle, t) for t in common.utf8(batch.column(at)))
            yield batch.filter(pa.array([not _contaminated(_length(e), n, words_per_hit) for n, e, _ in judged],
                                        pa.bool_()))
    return clean


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                  block_words: int = BLOCK_WORDS, words_per_hit: int = WORDS_PER_HIT) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    With one block of items the documents are filtered where they are read, without a
    shuffle; with more, the verdicts of all blocks are joined to the documents."""
    text = documents.select(documents["text"])
    indexes = _indexes(text, benchmark, window, shingle, block_words)
    if len(indexes) == 1:
        return documents.mapInArrow(
            _clean_task(indexes[0], shingle, documents.columns.index("text"), words_per_hit), documents.schema)
    judged = scan(documents, benchmark, window, shingle, block_words, words_per_hit)
    bad = judged.where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).distinct()
    return documents.join(bad, documents["doc_id"].eqNullSafe(bad["_id"])
                          & (F.xxhash64(documents["text"]) == bad["_h"]), "left_anti")
