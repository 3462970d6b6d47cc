import math

import numpy as np
import pytest

from pricelens.llm import embeddings, queries
from .helpers import SF


def brute(rows, threshold=0.95):
    """(vec_id, n_links, component_id, kept) of (vec_id, components) rows by comparing all pairs."""
    def direction(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, np.float64) / max(map(abs, v))
        return a / np.sqrt(a @ a)

    units = [direction(v) for _, v in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    head = {}
    for i, (ident, _) in enumerate(rows):
        head.setdefault(root(i), []).append(ident)
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in head.items()}
    return sorted(((ident, links[i], least[root(i)], ident == least[root(i)]) for i, (ident, _) in enumerate(rows)), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 0, b"x") for i, v in rows], f"vec_id long, embedding array<{kind}>, rank int, node binary")


def planted(rng, size=24):
    """Strangers, pairs and chains near the threshold, a hot group of near copies, exact copies."""
    rows = [rng.standard_normal(size) for _ in range(150)]
    for _ in range(60):  # pairs at about the threshold, above and below
        a, b = rng.standard_normal((2, size))
        b -= a * (a @ b) / (a @ a)
        t = math.acos(0.95) * rng.uniform(0.2, 1.3)
        rows += [a, math.cos(t) * a + math.sin(t) * b * np.linalg.norm(a) / np.linalg.norm(b)]
    centre = rng.standard_normal(size)
    rows += [centre + 0.12 * rng.standard_normal(size) for _ in range(120)]
    rows += [rows[0]] * 5 + [rows[0] * 3.0]
    return [(100 + i, np.float32(v).tolist()) for i, v in enumerate(rows)]


AWKWARD = [(1, None), (2, []), (3, [0.0] * 24), (4, [1.0] * 23 + [None]), (5, [float("nan")] * 24), (6, [float("inf")] * 24),
           (None, [1.0] * 24), (7, [1.0] * 24), (8, [1e-30] * 24), (9, [1.0] * 12), (9, [2.0] * 12), (9, [2.0] * 12),
           (10, [-1.0] * 24), (None, [-1.0, 1.0] * 12), (None, [-1.0, 1.0] * 12), (11, [-0.0, 1.0]), (12, [0.0, 1.0])]


@pytest.mark.parametrize("window, block", [(512, 4096), (16, 32)])
def test_links_and_components_equal_all_pairs(spark, window, block):
    rows = planted(np.random.default_rng(3)) + AWKWARD
    got = embeddings.near_duplicates(table(spark, rows).repartition(5), window=window, block=block)
    assert found(got) == brute(rows)


def test_doubles_and_empty_table(spark):
    rows = [(i, v) for i, v in planted(np.random.default_rng(5))[:200]] + [(1, [1e200, 1e-200]), (2, [1.0, 0.0])]
    assert found(embeddings.near_duplicates(table(spark, rows, "double"))) == brute(rows)
    assert embeddings.near_duplicates(table(spark, [])).count() == 0


def test_query_equals_all_pairs(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert found(queries.embedding_near_dedup(spark, SF)) == brute(rows)


def test_recall_of_the_windows_alone():
    """Pairs just above the threshold among many strangers, found by the passes without the step inside components."""
    rng = np.random.default_rng(11)
    n, size, window = 4000, 48, 64
    base = rng.standard_normal((n, size))
    base /= np.linalg.norm(base, axis=1)[:, None]
    other = rng.standard_normal((200, size))
    other -= base[:200] * np.einsum("ij,ij->i", other, base[:200])[:, None]
    other /= np.linalg.norm(other, axis=1)[:, None]
    t = math.acos(0.951)
    matrix = np.concatenate([base, math.cos(t) * base[:200] + math.sin(t) * other])
    names = [i.to_bytes(4, "big") for i in range(len(matrix))]
    caught = set()
    for p in range(embeddings.passes_for(len(matrix), window=window)):
        signs = np.packbits(matrix @ embeddings.projection(size, p) > 0, axis=1)
        order = sorted(range(len(matrix)), key=lambda i: signs[i].tobytes())
        edges = embeddings.window_edges([names[i] for i in order], np.arange(len(order)),
                                        [matrix[i].tobytes() for i in order], "<f8", window, 0.95)
        caught |= {frozenset(e) for e in edges}
    assert len(caught & {frozenset((names[i], names[n + i])) for i in range(200)}) >= 196
