"""Token-ID output as Arrow files of equal-length sequences.

Documents are sorted over the whole cluster; each task encodes its range and writes one
shard, an Arrow IPC file whose batches hold ``tokens`` (fixed_size_list, uint16 where the
vocabulary allows it, else uint32) and ``mask`` (fixed_size_list<uint8>, eight positions a byte, low
bit first: 1 a token, 0 padding at the end of the shard).  All sequences have the same length, so sequence i of a mapped file is a slice without a copy
(``sequence``).  A second Arrow file holds doc_id, start and n_tokens of the shard's
documents.  A manifest, written by Spark, names the files of the attempts that succeeded:
files of lost or repeated attempts are never read.  The readers start from the manifest.

Encoding: the byte-level pre-tokeniser never joins text across the start of a single
space or line end, so such chunks are encoded on their own, each once, and remembered; texts with
runs of white space are cut by a pattern that keeps the runs whole.  What is remembered
is bounded (``REMEMBERED`` chunks, then forgotten), and affects speed only.  A tokenizer of
another kind, and a text that holds an added token, is encoded in one piece.

Cases: a null text is an empty one; every document, also an empty one, has its end
id; equal doc_ids are ordered by a hash of their texts; null doc_ids come first; an empty
table writes no shard and reads back as no rows; batches bound the memory of a writer,
whatever the length of a text's ids; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEQUENCE, BATCH_SEQUENCES, END_ID = 2048, 512, 2
REMEMBERED, LONGEST, GROUP_CHARS = 750_000, 64, 1 << 16

_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACES = frozenset(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
                              0x205F, 0x3000]))
_RUN = re.compile(f"[{_SPACE}][{_SPACE}]")
_MARKS = frozenset(".,;:!?")
_LETTERS = frozenset(c for c in map(chr, range(256)) if c.isalpha())
_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[0-9]+")
_LEAD = "\u0120"  # a space, as the byte-level vocabulary writes it
_CHUNK = re.compile(f"[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]?[^{_SPACE}]+")


class Remembered:
    """Ids by chunk in two generations: when the new one is full, it becomes the old one and the old one goes."""

    def __init__(self, limit: int):
        self.limit = limit
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def make_room(self, chunks: int) -> None:
        if len(self.new) + chunks > self.limit:
            self.new, self.old = {}, self.new

    def renew(self, chunk: str) -> bool:
        """Whether the ids are known; they are in the new generation then."""
        if chunk not in self.new and chunk in self.old:
            self.new[chunk] = self.old[chunk]
        return chunk in self.new


class Encoder:
    """Ids of a text, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, remembered: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        cut = kind.get("pre_tokenizer") or {}
        self.whole = not (cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
                          and not kind.get("normalizer") and not kind.get("truncation") and not kind.get("padding"))
        self.added = [t["content"] for t in kind.get("added_tokens", [])]
        self.line_end = int(self._ids("\n")[0]) if not self.whole else -1
        self.marks = {m: self._ids(m).tobytes() for m in _MARKS} if not self.whole else {}
        names = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(names.values(), default=0) + 1, bool)  # tokens that begin with a space
        self.leads[[i for name, i in names.items() if name[0] == _LEAD]] = True
        self.uncut = Tokenizer(self.tokenizer.model)  # the same vocabulary, for words that the pre-tokeniser leaves whole
        written = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.alphabet = {ord(c): written(c)[0][0] for c in _LETTERS if not c.isascii()}
        limit = REMEMBERED if remembered is None else remembered
        self.words = Remembered(limit)   # by the text after a space, or from a line end on
        self.chunks = Remembered(limit)  # by the chunk itself

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _remember(self, memory: Remembered, chunks: dict[str, str]) -> None:
        """Encode new chunks (by their key).  A mark after a letter is a token of its own, so only what
        stands before it is encoded.  Chunks after a space go in one call, as just the first token of
        each begins with a space, and of these words of letters or of digits in one that cuts no words;
        those without go in another, a line end between them."""
        known, marked, words, spaced, lines = memory.new, [], {}, {}, {}
        for key, chunk in chunks.items():
            if chunk[-1] in _MARKS and len(chunk) > 2 and chunk[-2] in _LETTERS:
                marked.append(key)
                key, chunk = key[:-1], chunk[:-1]
                if memory.renew(key):
                    continue
            if "\n" in chunk[1:] or chunk[-1] in _SPACES or chunk[0] in _SPACES and (chunk[0] not in " \n" or chunk[1] in _SPACES):
                known[key] = self._ids(chunk).tobytes()
            elif chunk[0] == " ":
                (words if _WORD.fullmatch(chunk, 1) else spaced)[key] = chunk
            else:
                lines[key] = chunk
        if words:
            whole = [_LEAD + (w[1:] if w.isascii() else w[1:].translate(self.alphabet)) for w in words.values()]
            ids = np.array(self.uncut.encode_batch_fast([whole], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            self._cut(known, list(words), ids, np.flatnonzero(self.leads[ids]), 0)
        if spaced:
            ids = self._ids("".join(spaced.values()))
            self._cut(known, list(spaced), ids, np.flatnonzero(self.leads[ids]), 0)
        if lines:
            ids = self._ids("".join(c if c[0] == "\n" else "\n" + c for c in lines.values()))
            starts = np.flatnonzero(ids == self.line_end)
            self._cut(known, list(lines), ids, starts, [c[0] != "\n" for c in lines.values()])
        for key in marked:
            known[key] = known[key[:-1]] + self.marks[key[-1]]

    def _cut(self, known: dict[str, bytes], keys: list[str], ids: np.ndarray, starts: np.ndarray, skip) -> None:
        if len(starts) != len(keys):
            raise ValueError("a chunk was not encoded on its own")
        raw = ids.tobytes()
        for key, start, end in zip(keys, ((starts + skip) * 4).tolist(), [*(starts[1:] * 4).tolist(), len(raw)]):
            known[key] = raw[start:end]

    def _found(self, memory: Remembered, lists: list[list[str]], chunk) -> list[bytes]:
        """The joined ids of each list of parts."""
        got = [list(map(memory.new.get, parts)) for parts in lists]
        holes = [[i for i, g in enumerate(row) if g is None] if None in row else () for row in got]
        new = {parts[i] for parts, at in zip(lists, holes) for i in at}
        memory.make_room(len(new))
        self._remember(memory, {p: chunk(p) for p in new if p not in memory.old or not memory.renew(p)})
        for parts, row, at in zip(lists, got, holes):
            for i in at:
                row[i] = memory.new[parts[i]]
        for p in new:
            if len(p) > LONGEST:
                memory.new.pop(p, None)
                memory.new.pop(p[:-1], None)  # a mark's chunk
        return [b"".join(row) for row in got]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        direct: dict[int, bytes] = {}
        chunks: list[list[str]] = []
        rests: list[list[str]] = []
        for i, text in enumerate(texts):
            cut: tuple[list[str], list[str]] = ([], [])
            if not text:
                pass
            elif self.whole or any(a in text for a in self.added):
                direct[i] = self._ids(text).tobytes()
            elif _RUN.search(text):
                cut = (_CHUNK.findall(text), [])
            else:
                first, *rest = text.replace("\n", " \n").split(" ")
                cut = ([first] if first else [], rest)
            chunks.append(cut[0])
            rests.append(cut[1])
        heads = self._found(self.chunks, chunks, str)
        tails = self._found(self.words, rests, lambda p: p if p[:1] == "\n" else " " + p)
        return [direct.get(i) or head + tail for i, (head, tail) in enumerate(zip(heads, tails))]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, remembered: int | None = None) -> Encoder:
    """One encoder a worker process; that of another limit goes."""
    if (path, remembered) not in _encoders:
        for other in [k for k in _encoders if k[0] == path]:
            del _encoders[other]
        _encoders[path, remembered] = Encoder(path, remembered)
    return _encoders[path, remembered]


def _schema(sequence: int, kind: pa.DataType) -> pa.Schema:
    if sequence % 8:
        raise ValueError("the sequence length must be a multiple of 8")
    return pa.schema([("tokens", pa.list_(kind, sequence)), ("mask", pa.list_(pa.uint8(), sequence // 8))])


class Shard:
    """Writes ids as batches of equal-length sequences."""

    def __init__(self, sink, sequence: int, vocabulary: int):
        self.sequence, self.pending, self.written = sequence, bytearray(), 0
        self.kind = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
        self.schema = _schema(sequence, pa.from_numpy_dtype(self.kind))
        self.file = ipc.new_file(sink, self.schema)

    def _batch(self, raw: bytes) -> None:
        n = len(raw) // 4
        room = -(-n // self.sequence) * self.sequence
        tokens, mask = np.zeros(room, self.kind), np.zeros(room, np.uint8)
        tokens[:n], mask[:n] = np.frombuffer(raw, "<u4"), 1
        mask = np.packbits(mask, bitorder="little")
        self.file.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(x), f.type.list_size)
             for x, f in zip((tokens, mask), self.schema)], schema=self.schema))

    def add(self, raw: bytes) -> None:
        self.pending += raw
        self.written += len(raw) // 4
        size = 4 * self.sequence * BATCH_SEQUENCES
        while len(self.pending) >= size:
            self._batch(bytes(self.pending[:size]))
            del self.pending[:size]

    def close(self) -> None:
        if self.pending:
            self._batch(bytes(self.pending))
        self.file.close()


def _groups(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column in groups of about ``GROUP_CHARS`` characters."""
    group, size = [], 0
    for text in column:
        group.append(text.as_py() or "")
        size += len(group[-1])
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _write_task(path: str, folder: str, sequence: int, end_id: int, remembered: int | None):
    end = np.array([end_id], "<u4").tobytes()
    index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encode = TaskContext.get(), encoder(path, remembered).encode_many
        fs, base = common.open_filesystem(folder)
        name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}"
        docs = 0
        shard = sinks = index = None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if shard is None:
                    fs.create_dir(base, recursive=True)
                    sinks = [fs.open_output_stream(f"{base}/{name}.{x}") for x in ("arrow", "index")]
                    shard, index = Shard(sinks[0], sequence, max(encoder(path, remembered).tokenizer.get_vocab_size(), end_id + 1)), ipc.new_file(sinks[1], index_schema)
                starts, counts = [], []
                for texts in _groups(batch.column(1)):
                    for raw in encode(texts):
                        starts.append(shard.written)
                        shard.add(raw + end)
                        counts.append(shard.written - starts[-1])
                docs += batch.num_rows
                index.write_batch(pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())],
                    schema=index_schema))
            if shard is not None:
                shard.close()
                index.close()
        finally:
            for s in sinks or []:
                s.close()
        if shard is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (context.partitionId(), f"{folder}/{name}.arrow",
                                           f"{folder}/{name}.index", docs, shard.written)],
                ["shard", "tokens_path", "index_path", "n_docs", "n_tokens"])
    return write


def write(documents: DataFrame, tokenizer: str, order: list | None = None, sequence: int = SEQUENCE,
          end_id: int = END_ID, remembered: int | None = None) -> DataFrame:
    """Write shards to the shared folder; returns the manifest, with the ids before each shard.

    ``order``: columns to sort by, without it doc_id and a hash of the text.  ``remembered``: chunks of a
    generation, fewer where workers also hold other stages' memory."""
    folder = common.shared_folder(documents.sparkSession, "tokens")
    by = order or [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    docs = documents.orderBy(*by).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = common.written(docs.mapInArrow(
        _write_task(tokenizer, folder, sequence, end_id, remembered),
        "shard long, tokens_path string, index_path string, n_docs long, n_tokens long"), "tokens-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return shards.withColumn("shard_start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _source(uri: str):
    """A shard's file: mapped where it is local, so that reading it copies nothing."""
    from pyarrow import fs
    system, path = common.open_filesystem(uri)
    return pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)


def sequence(path: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask (packed) of one sequence of a shard in a local, mapped file, without copying."""
    file = ipc.open_file(pa.memory_map(path))
    batch = file.get_batch(number // BATCH_SEQUENCES)
    row, found = number % BATCH_SEQUENCES, []
    for c in batch.columns:
        length = c.type.list_size
        found.append(c.values.to_numpy(zero_copy_only=True)[row * length:(row + 1) * length])
    return tuple(found)


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def documents(tokens, index, shard: int, before: int) -> Iterator[pa.RecordBatch]:
        at, ids, number, base = 0, (), 0, 0  # the batch in hand covers [base, base + len(ids))
        for k in range(index.num_record_batches):
            rows, sums = index.get_batch(k), []
            for n in rows.column(2).to_pylist():
                crc, left = 0, n
                while left:
                    if at == base + len(ids):
                        batch = tokens.get_batch(number)
                        number, base = number + 1, base + len(ids)
                        ids = batch.column(0).values.to_numpy(zero_copy_only=True)
                    part = ids[at - base:at - base + left]
                    crc = zlib.crc32(part.astype("<u4").data, crc)
                    at, left = at + len(part), left - len(part)
                sums.append(crc)
            start = pa.array(np.asarray(rows.column(1)) + before, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), start, rows.column(2), pa.array(sums, pa.int64()),
                 pa.array([shard] * rows.num_rows, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    for batch in batches:
        for shard, tokens_path, index_path, before in zip(*(c.to_pylist() for c in batch.columns)):
            with _source(tokens_path) as tokens, _source(index_path) as index:
                yield from documents(ipc.open_file(tokens), ipc.open_file(index), shard, before)


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and shard of every document, from the files."""
    paths = manifest.select("shard", "tokens_path", "index_path", "shard_start")
    return paths.repartition(max(1, manifest.count()), "shard").mapInArrow(
        _read_task, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")
