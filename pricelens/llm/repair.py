"""Conversation structure repair: rank-convergence parallel Viterbi over chunks of turns.

A conversation's rows, by turn, are edited at the least cost so that the initials of its roles
read ``(s?(ua)+)?``: keep (0), rerole to user or assistant (2), delete (3; required for blank rows and
repeats), insert an empty user or assistant row anywhere (2); a row that is kept or reroled
although truncated costs 1 more.  Of the cheapest edits those are taken whose initials (D, I, K, R) are the ASCII-least.

The roles read so far leave four states (nothing, after s, after u, after a).  The state and an
edit's initial give the next state, so a conversation's cost to go is a vector of four numbers
at every place, from the end to the start, and the initials alone tell the repaired rows.

1. *Rows.* Equal rows become one with a number of copies before the shuffle, and the first turn
   of every (role, text) tells which rows repeat an earlier one.
2. *Chunks.* Rows are range-partitioned by (conversation, turn, role, text) and cut into chunks of bounded rows
   and characters, so a hot conversation is many chunks in many tasks.  A chunk is one row of a written table.
3. *Speculation.* Every chunk runs backward from the vector of a conversation's end, whatever follows it.
4. *Fix-up.* A chunk whose right neighbour's vector differs from the assumed one by more than a
   constant runs again from the right one, only until old and new vector differ by a constant:
   the rest stays as it was.  Passes rerun until no vector is wrong.  In pass i a task takes a group
   of ``FAN`` ** i chunks from right to left, so there are at most log(chunks) passes even if
   nothing converges (rows of unknown role only); usually one is enough.
5. *Tracing.* The stitched vectors tell the best edit in every state; a chunk maps the four states
   at its start to those at its end, the maps are composed over a conversation's chunks (a
   row a chunk), and every chunk then emits its edits from the state it is entered in.
6. *Digest.* A SHA-256 has to run over a conversation's text in order; one chunk does it alone,
   several are streamed through it, a chunk at a time.

Vectors are kept relative to their last number.  Only few are possible, so a step is a look-up
(``_back``, ``_step``) after the first time.

Cases: null roles and texts are one space, of which the first is no role and the second blank; rows without turn
come first, equal turns go by role and text; a null conv_id is a conversation; repeated rows
are repeats; empty tables give no rows; long texts are hashed whole; extra columns are ignored.
A conversation's audit is one value, as long as its rows are many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

CHUNK_ROWS, CHUNK_CHARS, FAN = 1024, 1 << 18, 8

NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
_NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # the state after an inserted or reroled row
_KEEP = {(NOTHING, "s"): AFTER_S, (NOTHING, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A,
         (AFTER_A, "u"): AFTER_U}
_ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
#: Cost of what is missing at the end of a conversation; only "nothing" and "after a" may end one.
END = (0, 4, 2, 0)
_LEGAL = frozenset(("su", "ua", "au"))

BLANK, DUPLICATE, TRUNCATED, FINE = range(4)
_BLANKS = " \t\n\x0b\x0c\r"

Vector = tuple[int, int, int, int]


@lru_cache(maxsize=1 << 16)
def _back(vector: Vector, initial: str, extra: int) -> tuple[Vector, int]:
    """Costs to go before a row that may stay, from those after it, as a vector relative to its last number, and that."""
    cost = []
    for state in range(4):
        best = min(vector[state] + 3, vector[_NEXT[state]] + 2 + extra)
        if (state, initial) in _KEEP:
            best = min(best, vector[_KEEP[state, initial]] + extra)
        cost.append(best)
    u, a = min(cost[AFTER_U], cost[AFTER_A] + 2), min(cost[AFTER_A], cost[AFTER_U] + 2)  # rows inserted before it
    cost = (min(cost[NOTHING], u + 2), min(cost[AFTER_S], u + 2), u, a)
    return tuple(c - a for c in cost), a


@lru_cache(maxsize=1 << 16)
def _step(after: Vector, state: int, initial: str, extra: int) -> tuple[str, int, int]:
    """The least initials of the edits up to and with a row that may stay, the state after it and their cost."""
    before, base = _back(after, initial, extra)
    letters, cost = "", 0
    while True:
        left = before[state] + base
        if after[state] + 3 == left:
            return letters + "D", state, cost + 3
        if before[_NEXT[state]] + base + 2 == left:
            letters, state, cost = letters + "I", _NEXT[state], cost + 2
        elif (state, initial) in _KEEP and after[_KEEP[state, initial]] + extra == left:
            return letters + "K", _KEEP[state, initial], cost + extra
        else:
            return letters + "R", _NEXT[state], cost + 2 + extra


class Row:
    """A row of a chunk: what the edits need, and how many copies follow each other."""
    __slots__ = ("role", "text", "copies", "fault")

    def __init__(self, role: str, text: str, copies: int, fault: int):
        self.role, self.text, self.copies, self.fault = role, text, copies, fault

    @property
    def live(self) -> bool:
        return self.fault >= TRUNCATED


def fault_of(text: str, repeated: bool) -> int:
    text = text.rstrip(_BLANKS)
    if not text:
        return BLANK
    return DUPLICATE if repeated else FINE if text[-1] in ".!?" else TRUNCATED


def code(row: Row) -> str:
    """A row that may stay as one letter: its initial (s, u, a, or x for others), small if truncated."""
    initial = row.role[:1] if row.role[:1] in ("s", "u", "a") else "x"
    return initial if row.fault == TRUNCATED else initial.upper()


def backward(codes: str, end: Vector) -> list[Vector]:
    """The vectors before every row of a chunk, then ``end``."""
    out = [end]
    for c in reversed(codes):
        out.append(_back(out[-1], c.lower(), c.islower())[0])
    return out[::-1]


def fixed(codes: str, old: Vector, new: Vector, start: Vector) -> tuple[Vector, int]:
    """The vector before a chunk after its end became ``new``, and how many rows it took to converge."""
    for done, c in enumerate(reversed(codes)):
        if old == new:
            return start, done
        old, new = _back(old, c.lower(), c.islower())[0], _back(new, c.lower(), c.islower())[0]
    return new, len(codes)


# ---------------------------------------------------------------------------
# rows and chunks


def _weighed(rows: DataFrame, copies: Column) -> DataFrame:
    """Distinct rows with their copies, and whether an earlier turn has the same role and text."""
    text = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    rows = rows.select(rows["conv_id"].alias("conv"), rows["turn"].cast("long").alias("turn"),
                       text("role").alias("role"), text("text").alias("text"), copies.cast("long").alias("copies"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    # the digest is exact but for a collision of SHA-256, and keeps texts out of the shuffle of first turns
    rows = rows.withColumn("mark", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    first = rows.where("copies > 0").groupBy("conv", "role", "mark").agg(
        F.max(F.col("turn").isNull()).alias("_unknown"), F.min("turn").alias("_turn"))
    first = first.select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("mark").alias("_mark"),
                         F.when(~F.col("_unknown"), F.col("_turn")).alias("_first"))
    found = rows.join(first, rows["conv"].eqNullSafe(first["_conv"]) & (rows["role"] == first["_role"])
                      & (rows["mark"] == first["_mark"]), "left")
    repeated = ~F.col("turn").eqNullSafe(F.col("_first"))
    return found.select("conv", "turn", "role", "text", "copies", repeated.alias("repeated"))


_CHUNK = "part long, codes string, first_role string, last_role string, first_turn long, last_turn long, turns long, " \
         "illegal long, blank long, duplicate long, truncated long, " \
         "roles array<string>, texts array<string>, copies array<long>, faults array<int>"


def _chunk_task(rows_of_chunk: int, chars: int):
    def summary(part: int, turns: list, rows: list[Row]) -> tuple:
        """One chunk; rows without copies are gone and only tell that the conversation exists."""
        kept = [(t, r) for t, r in zip(turns, rows) if r.copies]
        rows, known = [r for _, r in kept], [t for t, _ in kept if t is not None]
        illegal = sum(r.copies - 1 for r in rows) + sum(a.role[:1] + b.role[:1] not in _LEGAL for a, b in zip(rows, rows[1:]))
        count = dict.fromkeys(range(4), 0)
        for r in rows:
            count[r.fault] += 1
            count[BLANK if r.fault == BLANK else DUPLICATE] += r.copies - 1
        return (part, "".join(code(r) for r in rows if r.live), rows[0].role if rows else None, rows[-1].role if rows else None,
                known[0] if known else None, known[-1] if known else None, len(set(known)), illegal,
                count[BLANK], count[DUPLICATE], count[TRUNCATED], [r.role for r in rows], [r.text for r in rows],
                [r.copies for r in rows], [r.fault for r in rows])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, conv, turns, rows, size, kind = TaskContext.get().partitionId() << 32, None, [], [], 0, None
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            types = [kind, pa.int64(), *(pa.string(),) * 3, *(pa.int64(),) * 7, pa.list_(pa.string()),
                     pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            names = ["conv", *(f.split()[0] for f in _CHUNK.split(", "))]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

        held = 0
        for batch in batches:
            kind = batch.column(0).type
            for c, turn, role, text, copies, repeated in zip(*(x.to_pylist() for x in batch.columns)):
                if rows and (c != conv or len(rows) >= rows_of_chunk or size >= chars):
                    out.append((conv, *summary(number, turns, rows)))
                    number, turns, rows, held, size = number + 1, [], [], held + size, 0
                    if held >= chars or len(out) >= 1000:
                        yield made()
                        out, held = [], 0
                conv, size = c, size + len(text)
                turns.append(turn)
                rows.append(Row(role, text, copies, fault_of(text, repeated)))
        if rows:
            out.append((conv, *summary(number, turns, rows)))
        if out:
            yield made()
    return chunks


def chunks(rows: DataFrame, copies: Column | None = None, rows_of_chunk: int = CHUNK_ROWS,
           chars: int = CHUNK_CHARS) -> DataFrame:
    """A row for each chunk of a conversation's rows, written; ``part`` numbers them in order."""
    found = _weighed(rows, F.lit(1) if copies is None else copies)
    kind = found.schema["conv"].dataType.simpleString()
    keys = ["conv", "turn", "role", "text"]
    return common.written(found.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(
        _chunk_task(rows_of_chunk, chars), f"conv {kind}, {_CHUNK}"), "repair-chunks")


# ---------------------------------------------------------------------------
# vectors


def _speculate_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts = [backward(c, END)[0] for c in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([END] * len(starts), pa.list_(pa.int32())),
             pa.array(starts, pa.list_(pa.int32()))], ["conv", "part", "end", "start"])


def _fix_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, group, part, codes, end, start, right), a group's together from right to left; right: the vector that follows."""
    at, follows = None, None
    for batch in batches:
        out = []
        for conv, group, part, codes, end, start, right in zip(*(c.to_pylist() for c in batch.columns)):
            if (conv, group) != at:
                at, follows = (conv, group), tuple(right)
            start, _ = fixed(codes, tuple(end), follows, tuple(start))
            out.append((conv, part, follows, start))
            follows = start
        types = (batch.column(0).type, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)],
                                         ["conv", "part", "end", "start"])


def vectors(pieces: DataFrame, fan: int = FAN) -> DataFrame:
    """conv, part and end: the costs to go after every chunk, by fix-up passes over speculative ones."""
    kind = pieces.schema["conv"].dataType.simpleString()
    fields = f"conv {kind}, part long, end array<int>, start array<int>"
    found = common.written(pieces.select("conv", "part", "codes").mapInArrow(_speculate_task, fields), "repair-vectors")
    order, group = Window.partitionBy("conv").orderBy("part"), 1
    last = F.array(*map(F.lit, END))
    found = found.withColumn("several", F.count(F.lit(1)).over(Window.partitionBy("conv")) > 1)
    alone, found = found.where("not several").select("part", "end"), found.where("several")
    while True:
        right = F.coalesce(F.lead("start").over(order), last)
        stated = common.written(found.withColumn("right", right).withColumn(
            "group", F.floor((F.row_number().over(order) - 1) / group)), "repair-stated")
        if stated.where("right <> end").isEmpty():
            return alone.unionByName(found.select("part", "end"))
        todo = stated.join(pieces.select("part", "codes"), "part").select(
            "conv", "group", "part", "codes", "end", "start", "right")
        found = common.written(todo.repartition("conv", "group").sortWithinPartitions(
            "conv", "group", F.col("part").desc()).mapInArrow(_fix_task, fields), "repair-vectors")
        group *= fan


# ---------------------------------------------------------------------------
# tracing


def trace(codes: str, vectors_: list[Vector], state: int) -> tuple[int, int]:
    """State and cost after a chunk's rows that may stay."""
    cost = 0
    for k, c in enumerate(codes):
        _, state, paid = _step(vectors_[k + 1], state, c.lower(), c.islower())
        cost += paid
    return state, cost


def _map_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, part, codes, end, ...): the state after a chunk for each state before it."""
    for batch in batches:
        maps = []
        for codes, end in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            v = backward(codes, tuple(end))
            maps.append([trace(codes, v, s)[0] for s in range(4)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maps, pa.list_(pa.int32()))],
                                         [*batch.schema.names, "map"])


def _enter_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, part, map, first_role, last_role, first_turn, last_turn) in order: the state before each chunk,
    whether the roles at its left border are illegal and whether its first turn was seen before."""
    conv, state, role, turn, begun = None, NOTHING, None, None, False
    for batch in batches:
        out = []
        for c, part, onward, first_role, last_role, first_turn, last_turn in zip(*(x.to_pylist() for x in batch.columns)):
            if not begun or c != conv:
                conv, state, role, turn, begun = c, NOTHING, None, None, True
            illegal = role is not None and first_role is not None and role[:1] + first_role[:1] not in _LEGAL
            out.append((part, state, int(illegal), int(first_turn is not None and first_turn == turn)))
            state, role, turn = onward[state], role if last_role is None else last_role, turn if last_turn is None else last_turn
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)],
                                         ["part", "state", "border", "seen"])


def edits(rows: list[Row], end: Vector, state: int, last: bool) -> Iterator[tuple[str, str | None, str, int]]:
    """(initial, role, text, cost) of the edits of a chunk; role None: the row is gone."""
    codes = [code(r) for r in rows if r.live]
    v = backward("".join(codes), end)
    k = 0
    for r in rows:
        if r.live:
            c = codes[k]
            k += 1
            letters, onward, _ = _step(v[k], state, c.lower(), c.islower())
            for letter in letters:
                if letter == "I":
                    state = _NEXT[state]
                    yield "I", _ROLE[state], "", 2
            if letter == "D":
                yield "D", None, "", 3
            elif letter == "K":
                yield "K", r.role, r.text, int(c.islower())
            else:
                yield "R", _ROLE[onward], r.text, 2 + c.islower()
            state = onward
        for _ in range(r.copies - r.live):
            yield "D", None, "", 3
    while last and END[state]:
        state = _NEXT[state]
        yield "I", _ROLE[state], "", 2


def _rows(columns: list[list]) -> list[Row]:
    return [Row(*r) for r in zip(*columns)]


def _repair_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, part, roles, texts, copies, faults, end, state, last, alone, ...): audit, cost and repaired text;
    of a conversation's only chunk the digest instead of the text."""
    for batch in batches:
        out = []
        fields = [batch.column(i).to_pylist() for i in range(2, 10)]
        for *columns, end, state, last, alone in zip(*fields):
            found = list(edits(_rows(columns), tuple(end), state, last))
            text = "\n".join(f"{role}:{body}" for _, role, body, _ in found if role is not None).encode()
            any_row = any(role is not None for _, role, _, _ in found)
            out.append(("".join(f[0] for f in found), sum(f[3] for f in found), any_row,
                        None if alone else text, hashlib.sha256(text).hexdigest() if alone else None))
        types = (pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array([o[i] for o in out], t) for i, t in enumerate(types))],
            ["conv", "part", "audit", "cost", "any_row", "body", "repaired_sha256"])


def _stitch_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, part, audit, any_row, body) in order: one row a conversation of several chunks."""
    conv, audit, digest, rows = None, [], None, False
    kind = None

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], kind), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])],
            ["conv", "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.column(0).type
        for c, _, letters, any_row, body in zip(*(x.to_pylist() for x in batch.columns)):
            if digest is not None and c != conv:
                yield made()
                digest = None
            if digest is None:
                conv, audit, digest, rows = c, [], hashlib.sha256(), False
            audit.append(letters)
            if any_row:
                digest.update(b"\n" + body if rows else body)
                rows = True
    if digest is not None:
        yield made()


def _entered(pieces: DataFrame) -> DataFrame:
    """part, end, state, border, seen, last and alone of every chunk."""
    ends = vectors(pieces)
    kind = pieces.schema["conv"].dataType.simpleString()
    small = pieces.select("conv", "part", "codes", "first_role", "last_role", "first_turn", "last_turn").join(ends, "part")
    mapped = common.written(small.select("conv", "part", "codes", "end", "first_role", "last_role", "first_turn", "last_turn").mapInArrow(
        _map_task, f"conv {kind}, part long, codes string, end array<int>, first_role string, last_role string, "
                   "first_turn long, last_turn long, map array<int>").drop("codes"), "repair-maps")
    entered = mapped.select("conv", "part", "map", "first_role", "last_role", "first_turn", "last_turn").repartition(
        "conv").sortWithinPartitions("conv", "part").mapInArrow(_enter_task, "part long, state int, border long, seen long")
    order = Window.partitionBy("conv").orderBy("part")
    last = F.lead("part").over(order).isNull()
    placed = mapped.select("part", "end", last.alias("last"), (last & F.lag("part").over(order).isNull()).alias("alone"))
    return common.written(placed.join(entered, "part"), "repair-entered")


def repair(rows: DataFrame, copies: Column | None = None, rows_of_chunk: int = CHUNK_ROWS,
           chars: int = CHUNK_CHARS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    ``rows``: conv_id, turn, role, text.  ``copies``: how often each row stands; a conversation whose rows all stand
    0 times has zeros, an empty audit and the digest of nothing."""
    pieces = chunks(rows, copies, rows_of_chunk, chars)
    kind = pieces.schema["conv"].dataType.simpleString()
    entered = _entered(pieces)
    repaired = common.written(
        pieces.select("conv", "part", "roles", "texts", "copies", "faults").join(entered, "part").select(
            "conv", "part", "roles", "texts", "copies", "faults", "end", "state", "last", "alone").mapInArrow(
            _repair_task, f"conv {kind}, part long, audit string, cost long, any_row boolean, body binary, repaired_sha256 string"),
        "repair-edits")
    whole = repaired.where("body is null").select("conv", "audit", "repaired_sha256")
    several = repaired.where("body is not null").select("conv", "part", "audit", "any_row", "body").repartition(
        "conv").sortWithinPartitions("conv", "part").mapInArrow(
        _stitch_task, f"conv {kind}, audit string, repaired_sha256 string")
    faults = pieces.select("conv", "part", "first_turn", "last_turn", "turns", "illegal", "blank", "duplicate", "truncated").join(
        entered.select("part", "border", "seen"), "part").join(repaired.select("part", "cost"), "part")
    span = F.max("last_turn") - F.min("first_turn") + 1 - F.sum(F.col("turns") - F.col("seen"))
    totals = faults.groupBy("conv").agg(
        F.coalesce(span, F.lit(0)).alias("gaps"), F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"),
        F.sum("truncated").alias("truncated"), F.sum(F.col("illegal") + F.col("border")).alias("illegal"),
        F.sum("cost").alias("cost")).withColumnRenamed("conv", "conv_id")
    found = whole.unionByName(several)
    return totals.join(found, totals["conv_id"].eqNullSafe(found["conv"])).drop("conv")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the damage that crc32(conv_id:turn) % 20 names, and in ``copies`` how often they stand."""
    rows = conversations.select("conv_id", "turn", *(F.coalesce(conversations[c], F.lit(" ")).alias(c) for c in ("role", "text")))
    part = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def _turns_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as for ``_repair_task``: the repaired rows of each chunk."""
    for batch in batches:
        fields = [batch.column(i).to_pylist() for i in range(2, 9)]
        for k, (*columns, end, state, last) in enumerate(zip(*fields)):
            found = [f for f in edits(_rows(columns), tuple(end), state, last) if f[1] is not None]
            one = batch.slice(k, 1)
            yield pa.RecordBatch.from_arrays(
                [one.column(0).take(pa.array([0] * len(found), pa.int32())), one.column(1).take(pa.array([0] * len(found), pa.int32())),
                 pa.array(range(len(found)), pa.int64()), *(pa.array([f[i] for f in found], pa.string()) for i in (1, 2, 0))],
                ["conv_id", "part", "place", "role", "text", "edit"])


def repaired_turns(rows: DataFrame, copies: Column | None = None, rows_of_chunk: int = CHUNK_ROWS,
                   chars: int = CHUNK_CHARS) -> DataFrame:
    """The repaired rows: conv_id, part and place (in this order), role, text and edit (I, K or R)."""
    pieces = chunks(rows, copies, rows_of_chunk, chars)
    kind = pieces.schema["conv"].dataType.simpleString()
    return pieces.select("conv", "part", "roles", "texts", "copies", "faults").join(_entered(pieces), "part").select(
        "conv", "part", "roles", "texts", "copies", "faults", "end", "state", "last").mapInArrow(
        _turns_task, f"conv_id {kind}, part long, place long, role string, text string, edit string")
