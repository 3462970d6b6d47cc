"""Helpers shared by the corpus operators: shared folders, words, hashes, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# ---------------------------------------------------------------------------
# tables and shared storage


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a folder of its own;
    on a cluster a missing setting is an error, because executors share no disk.
    """
    base = checkpoint_dir(spark)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pricelens-llm-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a shared folder and read again (cuts the lineage)."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_filesystem(uri: str):
    """(pyarrow filesystem, path) of a shared folder, for tasks that write files of their own."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def source_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so extra columns of the input can't clash with an operator's own."""
    return df.select(*[df[n] for n in names])


# ---------------------------------------------------------------------------
# words: ASCII letters are lower-cased, every other ASCII character but digits separates

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words ``[0-9a-z\\x80-..]+`` of a UTF-8 text after lower-casing A-Z; None has none."""
    return text.translate(_FOLD).split() if text else []


def utf8(column: pa.Array) -> list[bytes | None]:
    """Values of an Arrow string column as UTF-8 bytes, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that a task's copies of their values and its own batches
    stay small; what Arrow has kept of them goes back at the end, as the worker lives on."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    batch = None
    pa.default_memory_pool().release_unused()


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)          # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_ROLL = np.random.default_rng(20240502).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_CHUNK = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 14, 1 << (n - 1).bit_length()) if n else 1 << 14
    if size not in _powers:
        one = np.ones(1, np.uint64)
        up = np.concatenate([one, np.full(size - 1, _MULTIPLIER)])
        down = np.concatenate([one, np.full(size - 1, _INVERSE)])
        _powers[size] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every bit of a 64-bit value over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_chunk(folded: bytes) -> np.ndarray:
    a = np.frombuffer(folded, np.uint8)
    inside = np.zeros(len(a) + 2, bool)
    inside[1:-1] = a != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_tables(len(a))
    prefix = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[:len(a)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def word_hashes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of each word, in order; memory is bounded by cutting between words."""
    if not text:
        return np.empty(0, np.uint64)
    folded = text.translate(_FOLD)
    if len(folded) <= _CHUNK:
        return _hash_chunk(folded)
    parts, at = [], 0
    while at < len(folded):
        end = folded.find(b" ", min(at + _CHUNK, len(folded)))
        end = len(folded) if end < 0 else end
        parts.append(_hash_chunk(folded[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words; a shorter, non-empty text is one run."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(n, size)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out += hashes[j:n - k + 1 + j] * _ROLL[j]
    return mix(out + np.uint64(k))


# ---------------------------------------------------------------------------
# prefix sums


def sums_before(counts: DataFrame, key: str, value: str, within: list[str] | None = None,
                fan: int = 4096) -> DataFrame:
    """``counts`` with the column ``before``: the sum of ``value`` over all smaller ``key`` s.

    Two levels: sums inside runs of ``fan`` keys (a task a run), and over the runs, of
    which there are ``fan`` times fewer.  ``within``: columns that keep their own sums."""
    within = within or []
    high = F.floor(F.col(key) / fan)
    counts = counts.withColumn("_high", high)
    runs = counts.groupBy(*within, "_high").agg(F.sum(value).alias("_sum"))
    up = Window.partitionBy(*within).orderBy("_high").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*within, "_high", F.coalesce(F.sum("_sum").over(up), F.lit(0)).alias("_below"))
    inner = Window.partitionBy(*within, "_high").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_inside", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(
        runs, [*within, "_high"]).withColumn("before", F.col("_inside") + F.col("_below")).drop(
        "_high", "_inside", "_below")


def place_among(borders: Column, key: Column) -> Column:
    """How many of ``borders``, an ascending array or null, are at most ``key``: found by halving."""
    halves = F.array(*[F.lit(1 << b) for b in reversed(range(30))])
    return F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get(borders, at + step - 1) <= key, at + step).otherwise(at))


# ---------------------------------------------------------------------------
# connected components


def components(edges: DataFrame, name: str, rounds: int = 64) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); a component's name is one of its nodes.

    Rounds of contraction: every node is merged into the least of itself and its neighbours,
    the edges are renamed and those that became equal or loops go, until none is left;
    then the merges are followed back from the last round to the first.  A star, however
    large, is gone after one round, a path of n nodes after about log n.  A hot node costs
    no task of its own: minima are combined before the shuffle, and the look-ups are joins
    on a unique key whose other side AQE may split.  Each round is written to the shared folder.
    """
    merges = []
    edges = written(edges.select("u", "v").distinct(), f"{name}-edges")
    for i in range(rounds):
        near = edges.select(F.col("u").alias("node"), "v").union(edges.select("v", "u")).groupBy("node").agg(
            F.min("v").alias("least"))
        merge = written(near.select("node", F.least("node", "least").alias("into")), f"{name}-merge{i}")
        merges.append(merge)
        edges = written(
            edges.join(merge.select(F.col("node").alias("u"), F.col("into").alias("a")), "u")
            .join(merge.select(F.col("node").alias("v"), F.col("into").alias("b")), "v")
            .where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), f"{name}-edges{i}")
        if edges.isEmpty():
            break
    else:
        raise RuntimeError(f"{name}: components not settled after {rounds} rounds")
    found = merges.pop().withColumnRenamed("into", "component")
    for merge in reversed(merges):
        later = found.select(F.col("node").alias("into"), "component")
        found = merge.join(later, "into", "left").select("node", F.coalesce("component", "into").alias("component"))
    return found
