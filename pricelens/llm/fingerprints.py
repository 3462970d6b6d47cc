"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text is the multiset of its paragraphs (lines).  Every paragraph is hashed to a wide
vector and the fingerprint is the sum of the vectors, lane by lane, modulo powers of two,
so it does not depend on the order of paragraphs, and inserting or deleting one adds or
subtracts its vector (``add``, ``subtract``) without reading the text again.  The vector has two parts:

* identity: ``IDENTITY`` lanes of 32 bits, the SHA-256 of the paragraph, summed modulo 2**32;
* likeness: ``LANES`` lanes that count, modulo 2**31, the set bits of a hash of each run of
  ``RUN`` words of the paragraph (of all its words, if it has fewer).  Words are what white space
  separates; a character of a script written without spaces, and each character of a word of over
  ``LONG_WORD`` characters, is a word of its own, so runs there are character n-grams.  Twice the count
  minus the runs is a random projection of the multiset of runs, so the cosine of two fingerprints
  estimates how much of the texts is shared, order included.

Equal texts, and texts with the same paragraphs in another order, have equal
fingerprints.  Only DataFrame functions are used.  The sums are taken where the rows
are read: grouping by the row's own key needs no shuffle of texts.

Cases: a null text is an empty one: one empty paragraph; a paragraph without words
counts in the identity part only; two fingerprints without words are alike
when they are equal; equal doc_ids are ordered by a hash of their texts; null doc_ids
come first; counts are exact for any text, as a string of under 2**31 bytes has fewer
words, and only sums by ``add`` may wrap around; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import place_among

IDENTITY, LANES, RUN, LONG_WORD = 8, 126, 3, 32
#: Documents that are neighbours in order share a bucket of about so many rows; beyond so many buckets (8 bytes each reach
#: the tasks) they grow, which costs no memory: a bucket is sorted, spilled and read in order.
BUCKET_ROWS, MAX_BUCKETS = 4000, 1 << 16
_OVERSAMPLE = 8  # sampled keys for each start of a bucket, so that buckets are alike

# Two lanes of 31 bits, 32 apart, share a long; each of the two 64-bit hashes of a run gives up to 32 longs.
_BITS, _PER_LONG = 32, 2
_MASK = (1 << 31) - 1
_ONES = sum(1 << (_BITS * i) for i in range(_PER_LONG))
_LONGS = LANES // _PER_LONG
_SHA_PARTS = [(13 * i, min(13, 64 - 13 * i)) for i in range(5)]  # hex digits that fit a long


#: White space of all scripts, and the scripts that put none between words.
_SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_UNSPACED = "([" + "".join(rf"\p{{Is{s}}}" for s in (
    "Han", "Hiragana", "Katakana", "Bopomofo", "Yi", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan", "Javanese")) + "])"


def _words(paragraph: Column) -> Column:
    """The words of a paragraph, in order; [''] where it has none."""
    def split(text):
        return F.split(text, F.lit(f"{_SPACE}+"))

    wide = F.octet_length(paragraph) > F.length(paragraph)  # ASCII alone has none of these scripts
    text = F.when(wide, F.regexp_replace(paragraph, _UNSPACED, " $1 ")).otherwise(paragraph)
    plain = split(text)
    cut = F.flatten(F.transform(plain, lambda w: F.when(F.length(w) > LONG_WORD, F.split(w, "")).otherwise(F.array(w))))
    words = F.array_remove(F.when(F.rlike(paragraph, F.lit(f"[^ ]{{{LONG_WORD + 1}}}")), cut).otherwise(plain), "")
    return F.when(F.trim(paragraph) == "", F.array(F.lit(""))).otherwise(words)


def sums(rows: DataFrame, keys: list[str], text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """``keys``, which name a row, ``carry`` (whole numbers of the row), ``fingerprint``, ``lanes`` (centred) and ``n_words``, the runs counted."""
    carry = carry or {}
    paragraphs = rows.select(*keys, *[c.cast("long").alias(k) for k, c in carry.items()],
                             F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_p"))
    own = [*keys, *carry]
    words = paragraphs.select(*own, F.sha2(F.col("_p").cast("binary"), 256).alias("_sha"), _words(F.col("_p")).alias("_w"))
    following = [F.slice("_w", j + 1, F.greatest(F.size("_w"), F.lit(1))).alias(f"w{j}") for j in range(1, RUN)]
    runs = words.select(*own, "_sha", F.posexplode_outer(F.arrays_zip(F.col("_w").alias("w0"), *following)).alias("_at", "_run"))
    runs = runs.select(*own, "_sha", F.coalesce("_at", F.lit(0)).alias("_at"), *[F.col(f"_run.w{j}").alias(f"_w{j}") for j in range(RUN)])
    full = F.col(f"_w{RUN - 1}").isNotNull()
    counts = full | ((F.col("_at") == 0) & (F.coalesce("_w0", F.lit("")) != ""))
    words = runs.where(full | (F.col("_at") == 0)).select(
        *own, F.when(F.col("_at") == 0, F.col("_sha")).alias("_sha"), counts.cast("long").alias("_n"),
        *[F.when(counts, F.xxhash64(*[f"_w{j}" for j in range(RUN)], F.lit(h))).otherwise(F.lit(0)).alias(f"_h{h}")
          for h in (0, 1)])
    # a string has under 2**31 runs, so neither lane of a long reaches the next one or the sign
    lanes = [F.sum(F.shiftright(f"_h{i % 2}", i // 2).bitwiseAND(F.lit(_ONES))).alias(f"_b{i}") for i in range(_LONGS)]
    marks = [F.sum(F.conv(F.substring("_sha", 8 * k + 1, 8), 16, 10).cast("long")).alias(f"_i{k}")
             for k in range(IDENTITY)]
    total = words.groupBy(*keys).agg(F.sum("_n").alias("n_words"), *[F.max(k).alias(k) for k in carry], *marks, *lanes)
    parts = [F.lpad(F.hex(F.col(f"_i{k}").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for k in range(IDENTITY)]
    parts += [F.lpad(F.hex(F.col(f"_b{i}")), 16, "0") for i in range(_LONGS)]
    centred = [(2 * F.shiftright(f"_b{i}", _BITS * j).bitwiseAND(F.lit(_MASK)) - F.col("n_words")).cast("double")
               for i in range(_LONGS) for j in range(_PER_LONG)]
    return total.select(*keys, *carry, "n_words", F.lower(F.concat(*parts)).alias("fingerprint"),
                        F.array(*centred).alias("lanes"))


def _fields(fingerprint: Column) -> Column:
    """All fields of a fingerprint, as longs: the identity lanes, then the packed lanes."""
    def field(at, length):
        return F.conv(F.substr(fingerprint, F.lit(at + 1), F.lit(length)), 16, 10).cast("long")
    return F.array(*[field(8 * k, 8) for k in range(IDENTITY)],
                   *[field(8 * IDENTITY + 16 * i, 16) for i in range(_LONGS)])


def _combined(a: Column, b: Column, sign: int) -> Column:
    def field(i, x, y):
        if i < IDENTITY:
            return F.lower(F.lpad(F.hex((x + sign * y).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
        lane = None
        for j in range(_PER_LONG):
            one = [F.shiftright(v, _BITS * j).bitwiseAND(F.lit(_MASK)) for v in (x, y)]
            placed = F.shiftleft((one[0] + sign * one[1]).bitwiseAND(F.lit(_MASK)), _BITS * j)
            lane = placed if lane is None else lane.bitwiseOR(placed)
        return F.lower(F.lpad(F.hex(lane), 16, "0"))

    x, y = _fields(a), _fields(b)
    return F.concat(*[field(i, x[i], y[i]) for i in range(IDENTITY + _LONGS)])


def add(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together: insertion of paragraphs."""
    return _combined(a, b, 1)


def subtract(a: Column, b: Column) -> Column:
    """The fingerprint of a without b's paragraphs: deletion."""
    return _combined(a, b, -1)


def likeness(a: Column, b: Column, lanes_a: Column, lanes_b: Column) -> Column:
    """0 to 1: the cosine of the centred lanes of two fingerprints; 1 where they are equal."""
    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    dot = total(F.zip_with(lanes_a, lanes_b, lambda p, q: p * q))
    norm = F.sqrt(total(F.transform(lanes_a, lambda p: p * p))) * F.sqrt(total(F.transform(lanes_b, lambda p: p * p)))
    cosine = F.when(norm > 0, dot / norm).otherwise(0.0)
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def with_next(documents: DataFrame) -> DataFrame:
    """doc_id, text, and ``next_text``, that of the next document in order of doc_id (of the
    first, after the last); the rows of a bucket are in one partition, in order ``_row``.

    Buckets are ranges of doc_id; every ``_OVERSAMPLE``-th of the keys drawn by their hash begins one.  A bucket's first
    rows are also sent to the bucket before (``_ghost``), so one shuffle of the texts is enough."""
    docs = documents.select(documents["doc_id"], F.coalesce(documents["text"], F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    keys = docs.select(key.alias("_key"))
    rows = keys.count()
    drawn = F.pmod(F.xxhash64("_key"), F.lit(max(BUCKET_ROWS, -(-rows // MAX_BUCKETS)) // _OVERSAMPLE or 1)) == 0
    sample = F.filter(F.array_sort(F.collect_set(F.when(drawn, F.col("_key")))), lambda k, i: i % _OVERSAMPLE == 0)
    least = F.coalesce(F.min("_key"), F.lit(0).cast("long"))
    starts = keys.agg(F.array_sort(F.array_union(F.array(least), sample)).alias("starts")).scalar()  # each is some row's key
    # read once and before the key is a column, the starts stay the subquery's one array: no row carries a copy
    own = F.get(F.transform(F.array("_starts"), lambda s: F.transform(F.array(place_among(s, key) - 1), lambda b: F.struct(
        b.alias("bucket"), (F.get(s, b) == key).alias("head"), (F.size(s) - 1).alias("last")))[0]), F.lit(0))
    docs = docs.withColumn("_starts", starts).withColumn("_own", own).drop("_starts").withColumns({"_b": F.col("_own.bucket"), "_last": F.col("_own.last"), "_head": F.col("_own.head"), "_key": key})
    before = F.when(F.col("_b") == 0, F.col("_last")).otherwise(F.col("_b") - 1)
    copies = F.when(F.col("_head"), F.array(F.struct(F.col("_b").alias("bucket"), F.lit(0).alias("ghost")),
                                   F.struct(before.alias("bucket"), F.lit(1).alias("ghost")))) \
        .otherwise(F.array(F.struct(F.col("_b").alias("bucket"), F.lit(0).alias("ghost"))))
    dealt = docs.withColumn("_copy", F.explode(copies)).select(
        "doc_id", "text", "_key", F.col("_copy.bucket").alias("_bucket"), F.col("_copy.ghost").alias("_ghost"))
    order = Window.partitionBy("_bucket").orderBy("_ghost", "_key", F.xxhash64("text"))
    return dealt.withColumns({"_row": F.row_number().over(order), "next_text": F.lead("text").over(order)})


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, edited_sha256, edited_fingerprint, near_edited, near_next of every document."""
    rows = with_next(documents)
    rows = rows.withColumn("_edited", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    sha = F.sha2(F.col("_edited").cast("binary"), 256)
    rows = rows.withColumns({"_sha_edited": sha, "_chars": F.length("text")})
    both = rows.select("_bucket", "_row", "_ghost", "doc_id", "_chars", "_sha_edited",
                       F.posexplode(F.array("text", "_edited")).alias("_kind", "_text"))
    digits = {f"_d{i}": F.conv(F.substring("_sha_edited", at + 1, n), 16, 10) for i, (at, n) in enumerate(_SHA_PARTS)}
    found = sums(both, ["_bucket", "_row", "_kind"], "_text",
                 {"_id": F.col("doc_id"), "n_chars": F.col("_chars"), "_copy": F.col("_ghost"), **digits})
    # still in the buckets' partitions: an edited text's row follows its text's
    order = Window.partitionBy("_bucket").orderBy("_row", "_kind")
    found = found.withColumns({
        "edited_fingerprint": F.lead("fingerprint").over(order), "_edited_lanes": F.lead("lanes").over(order),
        "_next": F.lead("fingerprint", 2).over(order), "_next_lanes": F.lead("lanes", 2).over(order)})
    found = found.where("_kind = 0 and _copy = 0")
    return found.select(
        F.col("_id").alias("doc_id"), "n_chars",
        F.lower(F.concat(*[F.lpad(F.hex(f"_d{i}"), n, "0") for i, (_, n) in enumerate(_SHA_PARTS)])).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), F.col("lanes"), F.col("_edited_lanes")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next"), F.col("lanes"), F.col("_next_lanes")).alias("near_next"))
