import os
import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import ipc
from pyspark.sql import functions as F

import corpus_pipeline
from pricelens.llm import queries, tokens
from .helpers import AWKWARD, LONG, documents

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
PATH = queries.tokenizer_path()


def whole(texts):
    return [e.ids for e in tokens.encoder(PATH).tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("ab'sS .,\n\t\r\x0b\x1c\x1f\x85\xa0\u3000é東9#<|>") + ["<|endoftext|>", "  ", "'ll"]),
                max_size=40).map("".join))
def test_chunks_encode_like_the_whole_text(text):
    assert np.frombuffer(tokens.encoder(PATH).encode(text), "<u4").tolist() == whole([text])[0]


def brute(rows):
    """start, n_tokens and crc32 by (doc_id, text) in order of doc_id (rows have none equal but copies)."""
    out, at = [], 0
    for doc, text in rows:
        ids = np.array(whole([text or ""])[0] + [2], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_hold_all_ids_in_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    manifest = tokens.write(docs, PATH, sequence=64)
    got = sorted(tuple(r)[:4] for r in tokens.read(manifest).collect())
    assert got == brute(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    shards = manifest.orderBy("shard").collect()
    for s in shards:  # equal-length sequences, padding at the end only, slices without a copy
        path = s["tokens_path"].removeprefix("file:")
        file = ipc.open_file(pa.memory_map(path))
        n = sum(file.get_batch(i).num_rows for i in range(file.num_record_batches))
        assert n == -(-s["n_tokens"] // 64)
        ids, mask = tokens.sequence(path, n - 1)
        assert len(ids) == 64 and not ids.flags.owndata
        mask = np.unpackbits(mask, bitorder="little")
        assert mask.sum() == (s["n_tokens"] - 1) % 64 + 1 and not ids[mask == 0].any()


def test_awkward_rows(spark):
    got = tokens.read(tokens.write(documents(spark, AWKWARD).repartition(3), PATH)).collect()
    assert len(got) == len(AWKWARD)
    by = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by] == sorted([r[0] for r in AWKWARD], key=lambda d: (d is not None, d or 0))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(by, by[1:]))
    null = next(r for r in got if r["doc_id"] == 1)
    assert (null["n_tokens"], null["ids_crc32"]) == (1, zlib.crc32(b"\x02\0\0\0"))
    long = next(r for r in got if r["doc_id"] == 7)
    assert long["n_tokens"] == len(whole([LONG])[0]) + 1
    assert tokens.read(tokens.write(documents(spark, []), PATH)).count() == 0


def test_given_order_is_kept(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    ranks = list(range(40))
    random.Random(1).shuffle(ranks)
    docs = docs.withColumn("rank", F.element_at(F.array(*map(F.lit, ranks)), (F.col("doc_id") + 1).cast("int")))
    got = tokens.read(tokens.write(docs, PATH, [F.col("rank")])).orderBy("start").collect()
    assert [ranks[r["doc_id"]] for r in got] == list(range(40))


def test_forgetting_chunks_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    e = tokens.Encoder(PATH)
    for text in ("one two three four five six", "six one seven\n\n eight  nine", LONG[:3000]):
        assert np.frombuffer(e.encode(text), "<u4").tolist() == whole([text])[0]


def test_words_are_encoded_like_the_whole_text():
    texts = ["größe Ñandú été 2024 straße 12ab ÿÀ×÷ xª yµ don't 東京 ok.", " ".join(f"w{i}é{i % 7} Ça{i % 11}" for i in range(500))]
    got = tokens.Encoder(PATH).encode_many(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == whole(texts)


def test_common_chunks_stay_while_rare_ones_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 1000)
    e, asked = tokens.Encoder(PATH), []
    remember = e._remember
    monkeypatch.setattr(e, "_remember", lambda known, chunks: (asked.extend(chunks), remember(known, chunks)))
    for k in range(40):
        e.encode("first common " + " ".join(f"w{k}q{i}" for i in range(300)))
    assert asked.count("common") == 1
    assert len(e.words.new) <= 1000 and len(e.words.old) <= 1000


def test_what_a_worker_of_the_pipeline_remembers_is_bounded():
    e = tokens.Encoder(PATH, corpus_pipeline.REMEMBERED)
    for k in range(0, 1_000_000, 5000):
        e.encode("first " + " ".join(f"{i:x}" for i in range(k, k + 5000)))
    e.encode("z" * 100_000 + " " + "y" * 100_000 + ".")
    held = [d for m in (e.words, e.chunks) for d in (m.new, m.old)]
    assert sum(map(len, held)) <= 800_000
    assert max(len(x) for d in held for x in d) <= tokens.LONGEST
