"""WARC archives with an index merged from sorted runs.

*Writing.* Payloads are grouped by SHA-256; of equal payloads of at least ``MIN_REVISIT`` bytes the
record with the smallest page_id is the response and the others are revisits that refer
to it.  Each task sorts its records by URL key and time and writes one archive, a gzip
member a record, and beside it a run: the records' index entries in the same order, as an
Arrow file in blocks of ``BLOCK`` entries.  A table of blocks (run, block, first and last key) names
the files of the attempts that succeeded; files of lost attempts are never read.

*Merging.* Passes merge groups of at most ``FAN_IN`` runs into one run each, written like the first ones, until
one group is left; its pass gives the index.  In every pass a group's keys are cut into ranges of about
``RANGE_ENTRIES`` entries, whose borders are the first keys of an even sample of its blocks, drawn by their hash.  A task
takes one range of a group, opens the blocks of the runs that reach into it and merges them with a
loser tree, a block of each run in memory at a time.  Keys are (URL key, time, page_id), so the
captures of one hot URL or host spread over ranges.  Range after range and entry after
entry the result is in global order: the capture history of every URL.  Borders are a key for every
``RANGE_ENTRIES`` entries, joined to the table of blocks (an entry for every ``BLOCK``); neither comes to the driver.

*Reading.* A task an archive fetches its records by offset and length and parses them; a response's digest
and length are taken from its payload, a revisit's from its headers.

Cases: a null html is an empty payload; a null or odd URL has a key of its own text; several
rows with the smallest page_id of a payload are all responses; a null page_id comes after
all others; an empty table writes nothing and reads back as no rows; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import ipc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_REVISIT, BLOCK, RANGE_ENTRIES, FAN_IN = 100, 512, 100_000, 256
_LAST = (1 << 63) - 1  # stands for a null page_id in keys

_ENTRY = pa.schema([("url_key", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()),
                    ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def url_key(url: Column) -> Column:
    """The URL with its host reversed, without scheme, ``www.``, port and fragment."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    name = F.array_join(F.reverse(F.split(F.regexp_replace(host, r"^www\d*\.", ""), r"\.")), ",")
    return F.when(host != "", F.concat(name, F.lit(")"), F.when(rest == "", "/").otherwise(rest))).otherwise(url)


def records(pages: DataFrame, captured: Column | None = None, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, url_key, captured (seconds), payload, digest, refers_to of every page.

    ``captured``: the time of capture; without one, page_id seconds after ``EPOCH``."""
    p = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"),
                     F.coalesce(pages["html"], F.lit("")).cast("binary").alias("payload"),
                     (captured if captured is not None else
                      F.coalesce(pages["page_id"], F.lit(0)).cast("long") + EPOCH).cast("long").alias("captured"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    # only payloads that occur more than once; their minimum is combined before the shuffle
    first = p.where(F.length("payload") >= min_revisit).groupBy("digest").agg(
        F.min("page_id").alias("response"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    p = p.join(first, "digest", "left")
    refers = F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return p.select("page_id", "url", url_key(F.col("url")).alias("url_key"), "captured", "payload", "digest",
                    refers.alias("refers_to"))


EPOCH = 1_704_067_200  # 2024-01-01T00:00:00Z, where pages carry no time of capture


def _name(page) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def _record(page, url, captured: int, payload: bytes, digest: str, refers) -> bytes:
    import datetime
    date = datetime.datetime.fromtimestamp(captured, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", _name(page)),
            ("WARC-Date", date), ("WARC-Target-URI", quote(url or "", safe="%:/?#[]@!$&'()*+,;=~")),
            ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("Page-Id", "" if page is None else str(page)), ("Payload-Length", str(len(payload)))]
    if refers is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", _name(refers)), ("Refers-To-Page-Id", str(refers))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers is None else b"")
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record (uncompressed)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


_BLOCK_KINDS = {"run": pa.string(), "path": pa.string(), "block": pa.int64(), "n": pa.int64(),
                "first_url": pa.string(), "first_time": pa.int64(), "first_page": pa.int64(),
                "last_url": pa.string(), "last_time": pa.int64(), "last_page": pa.int64()}
_BLOCK_SCHEMA = ", ".join(f"{k} {'string' if t == pa.string() else 'long'}" for k, t in _BLOCK_KINDS.items())


class _RunWriter:
    """Writes sorted entries to an Arrow file in blocks of ``size``; ``blocks`` are their rows of the table of blocks."""

    def __init__(self, run: str, path: str, size: int):
        fs, where = common.open_filesystem(path)
        fs.create_dir(where.rpartition("/")[0], recursive=True)
        self.run, self.path, self.size, self.blocks, self.entries = run, path, size, [], []
        self.sink = fs.open_output_stream(where, compression=None)
        self.file = ipc.new_file(self.sink, _ENTRY)

    def add(self, entry: tuple) -> None:
        self.entries.append(entry)
        if len(self.entries) == self.size:
            self._flush()

    def _flush(self) -> None:
        self.file.write_batch(pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*self.entries), _ENTRY.types)], schema=_ENTRY))
        a, z = self.entries[0], self.entries[-1]
        self.blocks.append((self.run, self.path, len(self.blocks), len(self.entries), *a[:3], *z[:3]))
        self.entries = []

    def close(self) -> list[tuple]:
        if self.entries:
            self._flush()
        self.file.close()
        self.sink.close()
        return self.blocks


def _block_rows(blocks: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*blocks)) or [()] * len(_BLOCK_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BLOCK_KINDS.values())], list(_BLOCK_KINDS))


def _write_task(folder: str, size: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        archive, run, sink, offset = f"{folder}/pages-{name}.warc.gz", None, None, 0
        try:
            for batch in batches:
                for page, url, key, captured, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    if run is None:
                        run = _RunWriter(name, f"{folder}/run-{name}.arrow", size)
                        fs, where = common.open_filesystem(archive)
                        sink = fs.open_output_stream(where, compression=None)
                    member = gzip.compress(_record(page, url, captured, payload, digest, refers), 6, mtime=0)
                    sink.write(member)
                    run.add((key, captured, _LAST if page is None else page, archive, offset, len(member)))
                    offset += len(member)
        finally:
            if sink is not None:
                sink.close()
        yield _block_rows(run.close() if run is not None else [])
    return write


def write(page_records: DataFrame) -> DataFrame:
    """Write archives and runs to the shared folder; returns the table of the runs' blocks."""
    folder = common.shared_folder(page_records.sparkSession, "warc")
    rows = page_records.sortWithinPartitions("url_key", "captured", F.col("page_id").asc_nulls_last())
    return common.written(rows.select("page_id", "url", "url_key", "captured", "payload", "digest", "refers_to").mapInArrow(
        _write_task(folder, BLOCK), _BLOCK_SCHEMA), "warc-blocks")


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.n = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.n
        for i in range(self.n):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is not None and y is None else x is not None and (x, a) < (y, b)

    def _play(self, i: int) -> None:
        node = (i + self.n) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1:  # the first to come waits here for its rival
                self.losers[node] = i
                return
            if self._less(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.n and self.heads[self.losers[0]] is not None:
            i = self.losers[0]
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def _entries(blocks: list[tuple[str, int]], low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """The entries of a run's blocks (file, block) with low <= key < high; one block is in memory at a time."""
    for path, block in blocks:
        fs, where = common.open_filesystem(path)
        with fs.open_input_file(where) as source:
            rows = ipc.open_file(source).get_batch(block).to_pylist()
        for r in rows:
            entry = tuple(r.values())
            if (low is None or entry[:3] >= low) and (high is None or entry[:3] < high):
                yield entry


def _merges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, LoserTree]]:
    """(group, range, merged entries) of rows in order of group, range and run."""
    now, low, high, runs = None, None, None, {}
    for batch in batches:
        for group, number, run, path, block, *keys in zip(*(c.to_pylist() for c in batch.columns)):
            if now is not None and (group, number) != now:
                yield *now, LoserTree([_entries(b, low, high) for b in runs.values()])
                runs = {}
            now = group, number
            low, high = (tuple(k.values()) if k else None for k in keys)
            runs.setdefault(run, []).append((path, block))
    if now is not None:
        yield *now, LoserTree([_entries(b, low, high) for b in runs.values()])


def _merge_to_runs(folder: str, size: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, number, merged in _merges(batches):
            run = None
            for entry in merged:
                if run is None:
                    run = _RunWriter(str(group), f"{folder}/run-{group}-{number}-{TaskContext.get().taskAttemptId()}.arrow", size)
                run.add(entry)
            yield _block_rows(run.close() if run is not None else [])
    return merge


def _merge_to_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(number, at, rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([number] * len(rows), pa.int64()), pa.array(range(at, at + len(rows)), pa.int64()),
             *(pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(_ENTRY), _ENTRY.types))],
            ["index_range", "index_row", *_ENTRY.names])

    for _, number, merged in _merges(batches):
        rows, at = [], 0
        for entry in merged:
            rows.append(entry)
            if len(rows) == 4096:
                yield out(number, at, rows)
                at, rows = at + len(rows), []
        yield out(number, at, rows)


def _ranges(blocks: DataFrame, range_entries: int, tasks: int) -> DataFrame:
    """Blocks dealt to the ranges of keys of their ``group`` (without that column, of all): a row for each range that a block reaches into."""
    def key(end: str) -> Column:
        return F.struct(F.col(f"{end}_url").alias("u"), F.col(f"{end}_time").alias("t"), F.col(f"{end}_page").alias("p"))

    drawn = blocks.where(F.pmod(F.xxhash64("first_url", "first_time", "first_page"), F.lit(max(1, range_entries // BLOCK))) == 0)
    sample = F.array_sort(F.collect_set(key("first"))).alias("_borders")
    if "group" in blocks.columns:
        blocks = blocks.join(drawn.groupBy("group").agg(sample), "group", "left")
    else:  # read once below, the borders stay the subquery's one array: no row carries a copy
        blocks = blocks.withColumns({"group": F.lit(0).cast("long"), "_borders": drawn.agg(sample).scalar()})
    reached = F.get(F.transform(F.array("_borders"), lambda b: F.transform(
        F.sequence(common.place_among(b, key("first")), common.place_among(b, key("last"))),
        lambda i: F.struct(i.cast("long").alias("number"), F.get(b, i - 1).alias("low"), F.get(b, i).alias("high")))), F.lit(0))
    dealt = blocks.select("group", "run", "path", "block", key("first").alias("first"), key("last").alias("last"),
                          reached.alias("_reached")).withColumn("to", F.explode("_reached"))
    return dealt.select("group", F.col("to.number").alias("number"), "run", "path", "block", F.col("to.low").alias("low"),
                        F.col("to.high").alias("high"), "first", "last").repartition(tasks, "group", "number").sortWithinPartitions(
        "group", "number", "run", "first", "last", "path", "block").drop("first", "last")


def merged_index(blocks: DataFrame, range_entries: int = RANGE_ENTRIES, fan_in: int = FAN_IN) -> DataFrame:
    """All index entries in global order of (index_range, index_row), as a table in the shared folder."""
    spark = blocks.sparkSession
    total, runs = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct("run")).first()
    tasks = max(1, -(-total // range_entries))
    passes = 0
    while runs > fan_in:
        groups, passes = -(-runs // fan_in), passes + 1
        order = Window.orderBy("run")  # a row a run
        numbers = blocks.select("run").distinct().withColumn("group", F.floor((F.row_number().over(order) - 1) / fan_in))
        folder = common.shared_folder(spark, f"warc-pass{passes}")
        blocks = common.written(_ranges(blocks.join(numbers, "run"), range_entries, tasks + groups).mapInArrow(
            _merge_to_runs(folder, BLOCK), _BLOCK_SCHEMA), f"warc-blocks{passes}")
        runs = groups
    last = _ranges(blocks, range_entries, tasks)
    return common.written(last.mapInArrow(
        _merge_to_index, "index_range long, index_row long, url_key string, captured long, page_id long, "
        "path string, offset long, length long"), "warc-index")


def _fetch_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured",
             "index_range", "index_row"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    for batch in batches:
        rows = sorted(zip(*(c.to_pylist() for c in batch.columns)), key=lambda r: (r[5], r[6]))  # file by file, along each
        found, opened, now = [], None, None
        for number, row, key, captured, page, path, offset, length in rows:
            if path != now:
                if opened:
                    opened.close()
                fs, where = common.open_filesystem(path)
                opened, now = fs.open_input_file(where), path
            opened.seek(offset)
            fields, payload = parse(gzip.decompress(opened.read(length)))
            revisit = fields["WARC-Type"] == "revisit"
            digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
            if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"{path} at {offset}: the payload differs from its digest")
            found.append((None if page == _LAST else page, int(fields["Payload-Length"]) if revisit else len(payload),
                          digest, fields["WARC-Type"], int(fields["Refers-To-Page-Id"]) if revisit else None,
                          key, captured, number, row))
        if opened:
            opened.close()
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names)


def read(index: DataFrame) -> DataFrame:
    """The archives' records in index entries: page_id, payload_bytes, payload_digest, record_type, refers_to, ..."""
    archives = max(1, index.agg(F.count_distinct("path")).first()[0])
    return index.repartition(archives, "path").mapInArrow(
        _fetch_task, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "url_key string, captured long, index_range long, index_row long")
