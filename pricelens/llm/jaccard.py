"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

A document's set holds its runs of ``SHINGLE`` words (a shorter text is one run).  Two
documents are linked when the Jaccard similarity of their sets is at least ``threshold``.

1. *Sets.* Documents with equal sets are one node (a 128-bit digest of the set), so exact
   copies are never compared; a node carries its number of copies.
2. *Forest.* A node's signature has ``TREES`` labels of ``DEPTH`` min-hashes.  The labels of each tree are sorted over the
   whole cluster, which lays its prefix trie out in order: a node's longest prefix shared with its predecessor is the
   depth at which the two part, and the nodes of a subtree are a run.  Every node is tied once, to the first node of
   the deepest run it shares, with that depth: a tree of ties, never all pairs.  A run cut by a task's border is tied across it.
   Matching begins with whole labels in all trees.  The expected recall at the threshold is 1 - prod(1 - threshold ** depth of a tree); while it
   is below ``recall``, that tree's prefix is shortened by one whose measured number of further candidate pairs is the
   least for what it adds, so trees in which shorter prefixes are common stay deep.
3. *Groups.* The connected components of the ties at least as deep as their tree's prefix hold every candidate pair.
4. *Verification.* A group is dealt into blocks of bounded size and every pair of blocks is a
   task of its own, so a hot group is split however large it is.  A task looks at the
   pairs that share a prefix in some tree, skips those whose set sizes rule the threshold
   out, and intersects the remaining sets exactly: by matrix product where many nodes
   share their shingles, by merging where few pairs are left.  It returns per node the
   number of links and a spanning forest of the links, at most one row a node.
5. *Classes.* The connected components of the forests are the classes.

Every document gets ``class_id``, the least doc_id of its class, and ``n_links``, the number of
other documents it is linked to, copies included.  Inside a group of n different texts all pairs of blocks are looked at, so its
time grows with n squared (by prefixes; sets only for pairs that share one), spread over the block pairs; nothing of that size is stored.
"Exact" means on 64-bit hashes of words and shingles: a chance of collision of about shingles squared / 2 ** 65.

Cases: null and word-less texts have empty sets, are linked to nothing and are their own
class; rows with equal doc_id are told apart by a hash of the text; a null doc_id sorts
before all others; extra columns are ignored by ``classes`` and kept by ``one_per_class``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
TREES, DEPTH = 24, 6
#: A block of a group: so many nodes and so many shingles, about.
BLOCK_NODES, BLOCK_SHINGLES = 2048, 1 << 20

_RNG = np.random.default_rng(20240601)
_A = _RNG.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def least_depth(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """One less than the longest prefix that gives the target recall in all trees alike: no tree is cut shorter."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return max(1, depth - 1)


def expected_recall(threshold: float, depths: list[int]) -> float:
    return 1 - float(np.prod([1 - threshold ** d for d in depths]))


def shortened(threshold: float, recall: float, pairs: dict[tuple[int, int], int], trees: int = TREES, depth: int = DEPTH) -> list[int]:
    """Each tree's prefix, shortened from whole labels one step at a time until the recall is met, where the step adds
    the fewest candidate pairs for the recall it adds.  ``pairs``: measured candidate pairs by (tree, depth)."""
    least, depths = least_depth(threshold, recall, trees, depth), [depth] * trees

    def price(tree: int) -> float:
        d = depths[tree]
        gain = np.log1p(-threshold ** d) - np.log1p(-threshold ** (d - 1))
        return (1 + pairs.get((tree, d - 1), 0) - pairs.get((tree, d), 0)) / gain

    while expected_recall(threshold, depths) < recall:
        open_trees = [t for t in range(trees) if depths[t] > least]
        if not open_trees:
            break
        depths[min(open_trees, key=price)] -= 1
    return depths


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit shingles of a text."""
    return np.unique(common.shingle_hashes(common.word_hashes(text), size))


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES x DEPTH min-hashes, of which 16 bits are kept."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    step = 1024
    for at in range(0, len(shingles), step):
        part = shingles[at:at + step]
        np.minimum(least, (part * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    return ((least >> np.uint64(24)) & np.uint64(0xFFFF)).astype(np.uint16)


def _prefixes(signatures: np.ndarray, depths: list[int]) -> np.ndarray:
    """[node, tree] 64-bit names of the label prefixes."""
    labels = signatures.reshape(len(signatures), TREES, DEPTH).astype(np.uint64)
    out = np.zeros(labels.shape[:2], np.uint64) + np.arange(TREES, dtype=np.uint64)
    for j in range(max(depths)):
        on = np.array(depths) > j
        out[:, on] = common.mix(out[:, on] * np.uint64(65537) + labels[:, on, j])
    return out


def _set_task(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            node, count, labels = [], [], []
            for text in common.utf8(batch.column(2)):
                s = shingle_set(text, size)
                node.append(set_digest(s) if len(s) else None)
                count.append(len(s))
                labels.append(signature(s).astype(">u2").tobytes() if len(s) else None)  # big-endian: sorted as numbers
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(node, pa.binary()), pa.array(count, pa.int64()),
                 pa.array(labels, pa.binary())], ["doc_id", "text_hash", "node", "n_shingles", "labels"])
    return sets


_TIES = "kind string, tree int, depth int, u binary, v binary, pairs long, part int, label binary"


def _trie_task(least: int):
    """Rows (tree, label, node) in order.  Gives a tie for each node that shares a prefix of ``least`` or more with its
    predecessor (u to the first node v of the run of that depth), the candidate pairs by tree and depth, and the task's first and last row."""
    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names = TaskContext.get().partitionId(), [f.split()[0] for f in _TIES.split(", ")]
        types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
        levels = range(least, DEPTH + 1)
        last, seen, pairs = None, 0, {}
        heads = {d: (0, None) for d in levels}  # by depth: place and node of the run's first row

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            node, out = batch.column(2).to_pylist(), []
            raw = batch.column(1).to_pylist()
            tree = np.asarray(batch.column(0))
            label = np.frombuffer(b"".join(raw), ">u2").reshape(n, DEPTH)
            if last is None:
                out.append(("first", int(tree[0]), None, node[0], None, None, part, raw[0]))
                same = np.zeros((n, DEPTH), bool)
                same[1:] = (label[1:] == label[:-1]) & (tree[1:] == tree[:-1])[:, None]
            else:
                before, above = np.vstack([last[1], label[:-1]]), np.append(last[0], tree[:-1])
                same = (label == before) & (tree == above)[:, None]
            shared = np.logical_and.accumulate(same, axis=1).sum(axis=1)
            place = np.arange(n)
            for d in levels:
                new = shared < d
                first = np.maximum.accumulate(np.where(new, place, -1))  # -1: the run began before this batch
                start, name = heads[d]
                from_head = np.where(first >= 0, place - first, seen + place - start)
                for t in np.unique(tree[~new]):
                    on = ~new & (tree == t)
                    pairs[int(t), d] = pairs.get((int(t), d), 0) + int(from_head[on].sum())
                for i in np.flatnonzero(shared == d):
                    head = node[first[i]] if first[i] >= 0 else name
                    out.append(("tie", int(tree[i]), d, node[i], head, None, part, None))
                if first[-1] >= 0:
                    heads[d] = (seen + int(first[-1]), node[first[-1]])
            last, seen = (tree[-1], label[-1], node[-1], raw[-1]), seen + n
            yield made(out)
        if last is not None:
            yield made([("pairs", t, d, None, None, n, part, None) for (t, d), n in pairs.items()]
                       + [("last", int(last[0]), None, last[2], None, None, part, last[3])])
    return tries


def forest(nodes: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, list[int]]:
    """Ties (u, v) between nodes (node, labels) that share a prefix, and the prefix of each tree."""
    width, least = 2 * DEPTH, least_depth(threshold, recall)
    rows = nodes.select("node", "labels", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.select("tree", F.expr(f"substring(labels, tree * {width} + 1, {width})").alias("label"), "node")
    found = common.written(
        rows.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node").mapInArrow(
            _trie_task(least), _TIES), "jaccard-tries")
    measured = found.where("kind = 'pairs'").groupBy("tree", "depth").agg(F.sum("pairs").alias("pairs"))
    depths = shortened(threshold, recall, {(r["tree"], r["depth"]): r["pairs"] for r in measured.collect()})  # trees x depths
    # a row a task: where a run goes on in the next task, its first row there is tied to the last row here
    ends = found.where("kind in ('first', 'last')").select(
        "tree", "u", "label", "kind", "part")
    order = Window.orderBy("part", F.col("kind") != "first")
    ends = ends.select("*", *[F.lag(c).over(order).alias(f"_{c}") for c in ("tree", "u", "label")]).where(
        "kind = 'first' and tree = _tree")
    deep = F.lit(0)
    for d in range(1, DEPTH + 1):
        deep = F.when(F.expr(f"substring(label, 1, {2 * d}) = substring(_label, 1, {2 * d})"), d).otherwise(deep)
    ties = found.where("kind = 'tie'").select("tree", "depth", "u", "v").unionByName(
        ends.select("tree", deep.alias("depth"), "u", F.col("_u").alias("v")))
    wanted = F.element_at(F.array(*map(F.lit, depths)), F.col("tree") + 1)
    return ties.where(F.col("depth") >= wanted).select("u", "v"), depths


def _text_task(size: int):
    """Nodes with their sets, computed again from one text each."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            made = [shingle_set(t, size) for t in common.utf8(batch.column(4))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3),
                 pa.array([s.tobytes() for s in made], pa.binary())], ["group", "blocks", "node", "copies", "shingles"])
    return sets


def _verify(node: list[bytes], copies: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray,
            same: bool, threshold: float, depths: list[int]):
    """Links between the nodes at ``left`` and those at ``right``: (documents linked, texts linked, forest)."""
    prefixes = _prefixes(np.stack([signature(s) for s in sets]), depths)
    size = np.array([len(s) for s in sets])
    documents, texts = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
    parent = list(range(len(node)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    step = 256
    for a0 in range(0, len(left), step):
        for b0 in range(a0 if same else 0, len(right), step):
            a, b = left[a0:a0 + step], right[b0:b0 + step]
            near = np.zeros((len(a), len(b)), bool)
            for t in range(TREES):
                near |= prefixes[a, t][:, None] == prefixes[b, t][None, :]
            small, large = np.minimum.outer(size[a], size[b]), np.maximum.outer(size[a], size[b])
            near &= small >= threshold * large - 1e-9
            if same and a0 == b0:
                near &= np.triu(np.ones(near.shape, bool), 1)
            i, j = np.nonzero(near)
            if not len(i):
                continue
            shared = _shared(sets, a, b, i, j)
            i, j = a[i], b[j]
            ok = shared >= threshold * (size[i] + size[j] - shared) - 1e-9
            i, j = i[ok], j[ok]
            np.add.at(documents, i, copies[j])
            np.add.at(documents, j, copies[i])
            np.add.at(texts, i, 1)
            np.add.at(texts, j, 1)
            for x, y in zip(i.tolist(), j.tolist()):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return documents, texts, [root(i) for i in range(len(node))]


def _shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (a[i], b[j])."""
    if len(i) < 64:
        return np.array([len(np.intersect1d(sets[a[x]], sets[b[y]], assume_unique=True)) for x, y in zip(i, j)])
    rows, columns = np.unique(i), np.unique(j)
    left = np.concatenate([sets[a[x]] for x in rows])
    right = np.concatenate([sets[b[y]] for y in columns])
    lid = np.repeat(np.arange(len(rows)), [len(sets[a[x]]) for x in rows])
    rid = np.repeat(np.arange(len(columns)), [len(sets[b[y]]) for y in columns])
    known = np.intersect1d(left, right)  # only these can be shared
    lk, rk = np.searchsorted(known, left), np.searchsorted(known, right)
    if len(known):
        lok, rok = known[np.minimum(lk, len(known) - 1)] == left, known[np.minimum(rk, len(known) - 1)] == right
    else:
        lok, rok = np.zeros(len(left), bool), np.zeros(len(right), bool)
    lid, lk, rid, rk = lid[lok], lk[lok], rid[rok], rk[rok]
    total = np.zeros((len(rows), len(columns)), np.float32)  # whole numbers below 2**24: exact
    width = 1 << 14
    for at in range(0, len(known), width):
        m, n = (lk >= at) & (lk < at + width), (rk >= at) & (rk < at + width)
        span = min(width, len(known) - at)
        x, y = np.zeros((len(rows), span), np.float32), np.zeros((len(columns), span), np.float32)
        x[lid[m], lk[m] - at] = 1
        y[rid[n], rk[n] - at] = 1
        total += x @ y.T
    return total[np.searchsorted(rows, i), np.searchsorted(columns, j)].astype(np.int64)


def _verify_task(threshold: float, depths: list[int]):
    """Rows (group, first, second, block, node, copies, shingles), those of a task together and in order."""
    def flush(rows: list[tuple]):
        key = rows[0][:3]
        node = [r[4] for r in rows]
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        copies = np.array([r[5] for r in rows], np.int64)
        block = np.array([r[3] for r in rows])
        left, right = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
        documents, texts, roots = _verify(node, copies, sets, left, right, key[1] == key[2], threshold, depths)
        return [(node[i], node[roots[i]], int(documents[i]), int(texts[i]))
                for i in range(len(node)) if texts[i]]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["u", "v", "documents", "texts"]

        def out(found):
            return pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], t) for k, t in
                 enumerate((pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names)

        rows, found = [], []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and rows[0][:3] != r[:3]:
                    found += flush(rows)
                    rows = []
                if not rows or rows[-1][4] != r[4]:  # repeated rows give a node twice
                    rows.append(r)
                if len(found) >= 10_000:
                    yield out(found)
                    found = []
        if rows:
            found += flush(rows)
        yield out(found)
    return verify


def classes(documents: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL,
            block_nodes: int = BLOCK_NODES, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """A row for each document: doc_id, text_hash, class_id, n_links (documents), n_copies, n_linked_texts, kept."""
    docs = documents.select(documents["doc_id"], F.xxhash64(documents["text"]).alias("text_hash"), documents["text"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = common.written(docs.mapInArrow(
        _set_task(shingle), f"doc_id {kind}, text_hash long, node binary, n_shingles long, labels binary"), "jaccard-sets")
    whole = sets.where("node is not null")
    nodes = common.written(whole.groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"),
        F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("labels").alias("labels")), "jaccard-nodes")

    edges, depths = forest(nodes, threshold, recall)
    groups = common.components(edges, "jaccard-groups")
    members = groups.join(nodes.drop("labels"), "node")
    blocks = members.groupBy("component").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / block_nodes), F.ceil(F.sum("n_shingles") / block_shingles)).cast("int").alias("blocks"))
    # one text of each node that has a candidate; equal sets can come from different texts
    # the number of blocks is looked up before the texts are, so no group's texts come together
    chosen = members.join(blocks, "component").select(
        F.col("component").alias("group"), "blocks", "node", "copies", "least")
    texts = chosen.join(docs, chosen["least.doc_id"].eqNullSafe(docs["doc_id"])
                        & (chosen["least.text_hash"] == docs["text_hash"])) \
        .select("group", "blocks", "node", "copies", "text").mapInArrow(
            _text_task(shingle), "group binary, blocks int, node binary, copies long, shingles binary")
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tasks = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "group", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
        "block", "node", "copies", "shingles")
    links = common.written(
        tasks.repartition("group", "first", "second").sortWithinPartitions("group", "first", "second", "node")
        .mapInArrow(_verify_task(threshold, depths), "u binary, v binary, documents long, texts long"), "jaccard-links")
    joined = common.components(links.select("u", "v"), "jaccard-classes")
    counts = links.groupBy(F.col("u").alias("node")).agg(
        F.sum("documents").alias("documents"), F.sum("texts").alias("texts"))
    node_class = nodes.select("node", "copies", "least").join(joined, "node", "left").join(counts, "node", "left") \
        .select("node", "copies", "least", F.coalesce("component", "node").alias("component"), "documents", "texts")
    heads = node_class.groupBy("component").agg(F.min("least").alias("head"))
    node_class = node_class.join(heads, "component").select(
        "node", "head", (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "copies", F.coalesce("texts", F.lit(0)).alias("n_linked_texts"))
    found = sets.select("doc_id", "text_hash", "node").join(node_class, "node", "left")
    itself = F.struct("doc_id", "text_hash")
    head = F.when(F.col("node").isNull(), itself).otherwise(F.col("head"))
    return found.select(
        "doc_id", "text_hash", head["doc_id"].alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"), F.coalesce("n_linked_texts", F.lit(0)).alias("n_linked_texts"),
        (head == itself).alias("kept"))


def one_per_class(documents: DataFrame, **options) -> DataFrame:
    """One document of each class, the one with the least (doc_id, text hash), with all columns.

    Word-less documents are their own classes; equal rows of them count as one."""
    kept = classes(documents, **options).where("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).distinct()
    rows = documents.withColumn("__text_hash", F.xxhash64(documents["text"]))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_id"]) & (rows["__text_hash"] == kept["_h"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "__text_hash"]).drop("__text_hash")
