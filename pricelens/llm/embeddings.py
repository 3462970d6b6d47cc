"""Embedding near-duplicates: sorted projection passes with bounded neighbour windows.

Two vectors are linked when their cosine, in double precision, is at least ``THRESHOLD``.

1. *Nodes.* Vectors with equal components are one node, which carries its number of copies,
   so copies are never compared.
2. *Passes.* In each pass a node's key is ``BITS`` concatenated signs of random projections (after
   the dimension); nodes are ordered lexicographically by key and every node is compared
   with the ``WINDOW`` next ones.  The order is cut into blocks by rank, and a block's task gets the
   first ``WINDOW`` nodes of the next one too, so no window ends at a task's border.  The
   comparisons are matrix products; pairs below the threshold are dropped there, and of the
   verified pairs a block returns a spanning forest, at most one row a node.
   Two vectors at the threshold's angle share k signs with probability (1 - angle / pi) ** k, and
   fall into one window about where k = log2(nodes / WINDOW); the number of passes follows
   from that for the target ``RECALL``, so it grows with the logarithm of the table.
3. *Union.* The forests of all passes are united into connected components.
4. *All links.* A window is bounded, a group of near copies is not: within each component every
   pair is compared exactly, so that no link inside it is lost and ``n_links`` is whole.  A component
   is dealt into blocks and every pair of blocks is a task of its own; a task returns counts a
   node, never pairs.

A component's name is the least vec_id in it.  The comparisons inside a component of n nodes
grow with n squared; nothing of that size is stored, and its blocks are copied n / ``BLOCK`` times.

Cases: vectors that are null, empty or zero or hold null or non-finite components link with
nothing and are their own component; vectors of unlike dimensions are never linked; rows
with equal vec_id are rows of their own; a null vec_id names a component only where no
other id is in it, and is kept there; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD, RECALL, BITS, WINDOW = 0.95, 0.999, 64, 512
#: Nodes of a block of a component, and rows of a matrix product.
BLOCK, TILE = 4096, 256
SEED = 20240701


def passes_for(nodes: int, threshold: float = THRESHOLD, recall: float = RECALL, window: int = WINDOW) -> int:
    """Passes until two vectors at the threshold share a window with probability ``recall``."""
    shared = max(1.0, math.log2(max(nodes, 1) / window)) if nodes > window else 1.0
    once = (1 - math.acos(threshold) / math.pi) ** shared
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - once)))


def units(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in doubles; a row without a direction becomes NaN."""
    matrix = matrix.astype(np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        matrix /= np.abs(matrix).max(axis=1, keepdims=True, initial=0)  # squares neither overflow nor vanish
        return matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]


def _node_task(kind: str):
    """Rows with their node, a digest of the components, and these as bytes; null where there is no direction."""
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, raws = [], []
            for row in batch.column(1):
                values = row.values
                values = None if values is None or values.null_count else np.asarray(values, kind) + 0  # + 0: no -0.0
                if values is None or not len(values) or not np.isfinite(units(values[None])).all():
                    names.append(None)
                    raws.append(None)
                else:
                    raws.append(values.tobytes())
                    names.append(hashlib.blake2b(raws[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "node", "raw"])
    return nodes


def _matrices(raws: list[bytes], kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """By dimension: the positions of its vectors, ascending, and the matrix of their units."""
    by_size: dict[int, list[int]] = {}
    for i, r in enumerate(raws):
        by_size.setdefault(len(r), []).append(i)
    return [(np.array(rows), units(np.frombuffer(b"".join(raws[i] for i in rows), kind).reshape(len(rows), -1)))
            for rows in by_size.values()]


def projection(dimension: int, number: int) -> np.ndarray:
    """The random directions of one pass: [dimension, BITS]."""
    return np.random.default_rng([SEED, dimension, number]).standard_normal((dimension, BITS))


def _key_task(passes: int, kind: str):
    """A row for each node and pass: the dimension and the signs of the projections, as bytes."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for rows, matrix in _matrices(batch.column(1).to_pylist(), kind):
                size = matrix.shape[1]
                names = batch.column(0).take(pa.array(rows))
                for p in range(passes):
                    if (size, p) not in directions:
                        directions[size, p] = projection(size, p)
                    signs = np.packbits(matrix @ directions[size, p] > 0, axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p] * len(rows), pa.int32()),
                         pa.array([size.to_bytes(4, "big") + s.tobytes() for s in signs], pa.binary()), names],
                        ["pass", "key", "node"])
    return keys


def _number_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pass, key, node) in order: their place in the task, by pass."""
    part, at = TaskContext.get().partitionId(), {}
    for batch in batches:
        place = []
        for p in batch.column(0).to_pylist():
            place.append(at.get(p, 0))
            at[p] = place[-1] + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([part] * len(place), pa.int64()), pa.array(place, pa.int64())],
            ["pass", "node", "part", "place"])


def ranks(nodes: DataFrame, passes: int, kind: str) -> DataFrame:
    """node and ranks, a map: the place of every node in the order of each pass."""
    keys = common.written(nodes.select("node", "raw").mapInArrow(
        _key_task(passes, kind), "pass int, key binary, node binary"), "embeddings-keys")
    placed = common.written(
        keys.repartitionByRange("pass", "key", "node").sortWithinPartitions("pass", "key", "node").mapInArrow(
            _number_task, "pass int, node binary, part long, place long"), "embeddings-order")
    counts = placed.groupBy("pass", "part").agg(F.count(F.lit(1)).alias("n"))
    before = common.sums_before(counts, "part", "n", ["pass"]).select("pass", "part", "before")
    rank = placed.join(before, ["pass", "part"]).select(
        "node", F.struct("pass", (F.col("before") + F.col("place")).alias("rank")).alias("entry"))
    return rank.groupBy("node").agg(F.map_from_entries(F.collect_list("entry")).alias("ranks"))  # an entry a pass


class _Forest:
    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)


def _collect(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows in groups of equal first ``keys`` values."""
    rows: list[tuple] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and rows[0][:keys] != r[:keys]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def _edges(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["u", "v"])


def window_edges(nodes: list[bytes], ranks: np.ndarray, raws: list[bytes], kind: str, window: int,
                 threshold: float) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the verified pairs that stand at most ``window`` ranks apart."""
    forest = _Forest(len(nodes))
    for rows, matrix in _matrices(raws, kind):
        rank = ranks[rows]
        for a in range(0, len(rows), TILE):
            end = int(np.searchsorted(rank, rank[min(a + TILE, len(rows)) - 1] + window, "right"))
            near = matrix[a:a + TILE] @ matrix[a:end].T >= threshold
            i, j = np.nonzero(near)
            ok = (j > i) & (rank[a + j] - rank[a + i] <= window)
            for x, y in zip(rows[a + i[ok]].tolist(), rows[a + j[ok]].tolist()):
                forest.join(x, y)
    return [(nodes[i], nodes[forest.root(i)]) for i in range(len(nodes)) if forest.parent[i] != i]


def _window_task(kind: str, window: int, threshold: float):
    """Rows (block, rank, node, raw), those of a block together and in order."""
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _collect(batches, 1):
            found = window_edges([r[2] for r in rows], np.array([r[1] for r in rows]), [r[3] for r in rows],
                                 kind, window, threshold)
            yield _edges(found)
    return edges


def pass_edges(placed: DataFrame, number: int, kind: str, window: int, threshold: float) -> DataFrame:
    """The forests of one pass (u, v) over nodes with their ranks."""
    size, rank = 8 * window, F.element_at("ranks", number)
    block = F.floor(F.col("rank") / size)
    dealt = placed.select("node", "raw", rank.alias("rank")).select(
        F.explode(F.when((F.col("rank") % size < window) & (block > 0), F.array(block, block - 1)).otherwise(
            F.array(block))).alias("block"), "rank", "node", "raw")
    return dealt.repartition("block").sortWithinPartitions("block", "rank").mapInArrow(
        _window_task(kind, window, threshold), "u binary, v binary")


def _count_task(kind: str, threshold: float):
    """Rows (component, first, second, block, node, copies, raw), those of a pair of blocks together."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, numbers = [], []
        for rows in _collect(batches, 3):
            first, second = rows[0][1:3]
            rows = list({r[4]: r for r in rows}.values())
            links = np.zeros(len(rows), np.int64)
            copies, block = np.array([r[5] for r in rows], np.int64), np.array([r[3] for r in rows])
            for at, matrix in _matrices([r[6] for r in rows], kind):
                left, right = np.flatnonzero(block[at] == first), np.flatnonzero(block[at] == second)
                for a0 in range(0, len(left), TILE):
                    for b0 in range(0, len(right), TILE):
                        a, b = left[a0:a0 + TILE], right[b0:b0 + TILE]
                        near = matrix[a] @ matrix[b].T >= threshold
                        if first == second:
                            near &= a[:, None] != b[None, :]
                        links[at[a]] += near @ copies[at[b]]
                        if first != second:
                            links[at[b]] += near.T @ copies[at[a]]
            for r, n in zip(rows, links.tolist()):
                if n:
                    names.append(r[4])
                    numbers.append(n)
            if len(names) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(numbers, pa.int64())], ["node", "links"])
                names, numbers = [], []
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(numbers, pa.int64())], ["node", "links"])
    return counts


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL,
                    window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of a table (vec_id, embedding)."""
    rows = embeddings.select(embeddings["vec_id"], embeddings["embedding"])
    ident = rows.schema["vec_id"].dataType.simpleString()
    kind = "<f4" if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    rows = common.written(rows.mapInArrow(_node_task(kind), f"vec_id {ident}, node binary, raw binary"), "embeddings-rows")
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("raw").alias("raw"))
    nodes = common.written(nodes, "embeddings-nodes")
    passes = passes_for(nodes.count(), threshold, recall, window)
    placed = common.written(nodes.select("node", "raw").join(ranks(nodes, passes, kind), "node"), "embeddings-ranks")
    edges = None
    for p in range(passes):  # one after the other, so only one pass's vectors are in a shuffle
        found = common.written(pass_edges(placed, p, kind, window, threshold), f"embeddings-pass{p}")
        edges = found if edges is None else edges.union(found)
    groups = common.components(edges, "embeddings")
    members = groups.join(nodes, "node")
    blocks = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = members.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tasks = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
        "block", "node", "copies", "raw")
    links = tasks.repartition("component", "first", "second").sortWithinPartitions("component", "first", "second", "node") \
        .mapInArrow(_count_task(kind, threshold), "node binary, links long").groupBy("node").agg(F.sum("links").alias("links"))
    heads = members.groupBy("component").agg(F.min("least").alias("head"))
    known = nodes.select("node", "copies", "least").join(groups, "node", "left").join(links, "node", "left").join(
        heads, "component", "left").select(
        "node", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("head")).alias("head"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    found = rows.select("vec_id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("head"))
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                        F.col("vec_id").eqNullSafe(component).alias("kept"))
