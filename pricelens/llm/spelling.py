"""Spelling variants: words that differ by one letter, found with a bit-sliced position index.

Words are the maximal runs of Latin letters of all texts, ASCII lower-cased, of at least
``MIN_LETTERS`` code points and ``MIN_COUNT`` occurrences.  Two words are near if one inserted,
deleted or replaced code point turns one into the other.  A word's form is its most
frequent near word, if that is at least ``RATIO`` times as frequent; its root is the end
of the chain of forms.

1. *Counting.* Runs are extracted, counted and combined before the shuffle in the JVM.
2. *Routing.* Of two near words let L be the shorter length and h = L // 2: they share
   the first h letters or the last L - h ones, whichever half the edit is not in.  So a
   word of length M has four keys, (L, half of the word) for L = M and L = M - 1; every near
   pair shares the key of its own L.  Keys are hashed to buckets whose number follows from the number of
   words; a key that holds more words than a block is dealt into blocks of index words
   and each of its words asks each of these blocks, so no key is one task.
3. *Index.* In a block, the bitset of (position, letter) holds the words with that letter there.
   A query runs once over its letters with four bitsets: words that match without an
   error, with one replaced letter, with one more letter (positions shifted by one) and
   with one less (shifted back).  A step is a handful of word-parallel ANDs and ORs for
   all words of the block, and a query ends when all four sets are empty.
4. *Counting near words.* A pair counts where it shares the block's key, by its first half if it
   can, so exactly once in each direction; a block returns the number and the best form
   of each query, never pairs.
5. *Roots.* Forms are followed by pointer doubling; counts at least double along a chain,
   so it has no cycle and at most log2(largest count) links.

A block's bitsets take at most positions x letters x words bits.  A block has ``BLOCK`` words of
up to ``LONG`` letters; each doubling of the length quarters that number, so memory is bounded
whatever the length of a run.

Cases: a null text has no words; a null doc_id stands as an empty string in ``damaged``; empty
texts and tables give no words; a long text is read whole; repeated rows count
again; forms of equal frequency go by code-point order; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LETTERS, MIN_COUNT, RATIO = 5, 3, 2
#: Index words of a block, for words of up to so many letters.
BLOCK, LONG = 1 << 14, 64


def runs(documents: DataFrame) -> DataFrame:
    """doc_id and run: a row for each occurrence of a run of letters, ASCII lower-cased."""
    text = F.translate(documents["text"], UPPER, LOWER)
    return documents.select(documents["doc_id"], F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))


def damaged(found: DataFrame, one_in: int = 97) -> Column:
    """The run, without one of its letters where ``one_in`` divides crc32(doc_id:run)."""
    run = found["run"]
    h = F.crc32(F.concat_ws(":", F.coalesce(found["doc_id"].cast("string"), F.lit("")), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % one_in == 0, cut).otherwise(run)


def vocabulary(words: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n of every word (column ``word``) that is long and frequent enough."""
    long = words.where(F.length("word") >= min_letters)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


class PositionIndex:
    """Bitsets over a block's words: by (position, letter), and by length."""

    def __init__(self, words: list[str]):
        self.words = words
        self.letters: dict[tuple[int, str], int] = {}
        self.lengths: dict[int, int] = {}
        at: dict[tuple[int, str], list[int]] = {}
        sizes: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            sizes.setdefault(len(w), []).append(k)
            for spot in enumerate(w):
                at.setdefault(spot, []).append(k)
        self.letters = {spot: self.bits(rows) for spot, rows in at.items()}
        self.lengths = {size: self.bits(rows) for size, rows in sizes.items()}

    def bits(self, rows: list[int]) -> int:
        raw = bytearray(-(-len(self.words) // 8))
        for k in rows:
            raw[k >> 3] |= 1 << (k & 7)
        return int.from_bytes(raw, "little")

    def near(self, word: str, among: int) -> tuple[int, int, int]:
        """Words of the set ``among`` with one letter replaced, one more and one less."""
        get, size = self.letters.get, len(word)
        same = among & self.lengths.get(size, 0)
        more, less = among & self.lengths.get(size + 1, 0), among & self.lengths.get(size - 1, 0)
        # exact: no error so far; the others: one error so far, of each kind
        exact, replaced, longer, shorter = same | more | less, 0, 0, 0
        for j, letter in enumerate(word):
            here, after = get((j, letter), 0), get((j + 1, letter), 0)
            before = get((j - 1, letter), 0)
            replaced = replaced & here | exact & same & ~here
            longer = (longer | exact & more) & after
            shorter = shorter & before | exact & less
            exact &= here
            if not (exact or replaced or longer or shorter):
                return 0, 0, 0
        return replaced, longer | exact & more, shorter

    def rows(self, bits: int) -> Iterator[int]:
        while bits:
            low = bits & -bits
            yield low.bit_length() - 1
            bits ^= low


def _shares(a: str, b: str, first: bool) -> bool:
    """Whether two words share the first (or last) half of the shorter length."""
    size = min(len(a), len(b))
    half = size // 2
    return a[:half] == b[:half] if first else a[half - size:] == b[half - size:]


def _index(building: dict[str, tuple[int, set]]) -> PositionIndex:
    index = PositionIndex(list(building))
    index.counts = [n for n, _ in building.values()]
    keys: dict[tuple[int, bool], list[int]] = {}
    for k, (_, kept) in enumerate(building.values()):
        for key in kept:
            keys.setdefault(key, []).append(k)
    index.keyed = {key: index.bits(rows) for key, rows in keys.items()}
    return index


def _ask(index: PositionIndex, size: int, first: bool, word: str) -> tuple[int, int, str | None]:
    """Number of near words that ``word`` finds by the half of length class ``size``, and the most frequent one."""
    near, best_n, best = 0, -1, None
    replaced, longer, shorter = index.near(word, index.keyed.get((size, first), 0))
    # the class is the shorter length: a word's own, or one less where it is the longer of the two
    for k in index.rows(replaced | longer if size == len(word) else shorter):
        other = index.words[k]
        if not _shares(word, other, first) or not first and _shares(word, other, True):
            continue
        near += 1
        n = index.counts[k]
        if n > best_n or n == best_n and other < best:
            best_n, best = n, other
    return near, best_n, best


def _near_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, block, asks, size, first, word, n): those of a bucket's block together, index words before queries."""
    at, building, index = None, {}, None
    for batch in batches:
        out = []
        for bucket, block, asks, size, first, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if (bucket, block) != at:
                at, building, index = (bucket, block), {}, None
            if not asks:
                building.setdefault(word, (n, set()))[1].add((size, first))
                continue
            index = index or _index(building)
            near, best_n, best = _ask(index, size, first, word)
            if near:
                out.append((word, near, best_n, best))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)],
                                         ["word", "n_near", "form_n", "form"])


def _room(size: int, block: int) -> int:
    """Words of a block for the lengths up to LONG << size."""
    return max(1, block >> 2 * size)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n, n_near and the most frequent near word (form, form_n) of a table of distinct words (word, n)."""
    words = words.select("word", "n")
    size = F.length("word")
    halves = [F.struct((size - d).alias("size"), F.lit(first).alias("first")) for d in (0, 1) for first in (True, False)]
    keys = words.select("word", "n", F.explode(F.array(*halves)).alias("_half")).select("word", "n", "_half.*")
    half = F.floor(F.col("size") / 2).cast("int")
    part = F.when(F.col("first"), F.substring("word", F.lit(1), half)).otherwise(
        F.substring("word", F.length("word") - F.col("size") + half + 1, F.col("size")))
    wide = F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / LONG))).cast("int")  # length class
    keys = common.written(keys.select("word", "n", "size", "first", wide.alias("wide"), F.xxhash64("size", "first", part).alias("key")),
                          "spelling-keys")
    # a class of lengths is a doubling of LONG: a handful of rows
    classes = {r["wide"]: r["count"] for r in keys.groupBy("wide").count().collect()}
    room, buckets = F.lit(1), F.lit(1)
    for c, n in classes.items():
        room = F.when(F.col("wide") == c, _room(c, block)).otherwise(room)
        buckets = F.when(F.col("wide") == c, -(-n // _room(c, block))).otherwise(buckets)
    hot = keys.groupBy("key", "wide").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > room).select(
        "key", F.ceil(F.col("_n") / room).cast("int").alias("blocks"))
    dealt = keys.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    fields = [F.xxhash64("wide", F.pmod("key", buckets)).alias("bucket"), "size", "first", "word", "n"]
    index = dealt.select(F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asks"), *fields)
    asks = dealt.select(F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), *fields)
    tasks = index.unionByName(asks).select("bucket", "block", "asks", "size", "first", "word", "n")
    partial = tasks.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "asks").mapInArrow(
        _near_task, "word string, n_near long, form_n long, form string")
    best = partial.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("_best"))
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("_best.form").alias("form"),
        (-F.col("_best.n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of every word that has a form (word, form): the end of its chain of forms."""
    links = common.written(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = common.written(links.join(onward, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        if links.where("_moved").isEmpty():
            return links.drop("_moved")
        links = links.drop("_moved")


def variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of a table of distinct words (word, n)."""
    found = near_words(words, block)
    fits = F.col("form_n") >= ratio * F.col("n")
    found = common.written(found.select("word", "n", "n_near", F.when(fits, F.col("form")).alias("form"),
                                        F.when(fits, F.col("form_n")).alias("form_n")), "spelling-forms")
    return found.join(roots(found), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
