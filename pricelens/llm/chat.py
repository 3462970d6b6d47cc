"""Chat formatting with layouts found by schema fingerprint.

*Layouts.* A record's fingerprint is the hash of its nested field paths (list elements are
``[]``), sorted.  It selects a declarative mapping (``LAYOUTS``) that turns prompt, instruction,
message-list and one-row-per-turn records into canonical turns (role, text).  Where the whole
fingerprint is unknown, that of the paths some layout knows decides, and the reason names the other
fields.  A record without a layout (unknown, malformed or too deeply nested JSON, a null record) is one
row with layout and role null, the record itself as text and a reason; it has no turns.

*Template.* A turn is ``### Role: text</turn>`` and a line end.  ``</turn>``, ``### `` and the backslash
inside texts are written as a backslash and a letter of their own, so no control string
can occur in an escaped text and unescaping gives the text back exactly.  The loss mask
is a list of spans (start, end, in code points) of the assistant texts.

A conversation's turns come together sorted and are formatted as a stream; the output is
cut between turns into parts of about ``PART_CHARS`` characters, so memory does not grow with
a conversation.  Reading back streams over the parts in order.

Cases: null texts and roles are empty; equal turn numbers go by role, then text; null
turn numbers come first; repeated rows are repeated turns; rows with a null conv_id are one
conversation; an empty table gives no conversation; extra columns are ignored.  An empty message
list is a record without turns; the parts of a list as content are joined by an empty line; half a
surrogate pair in a JSON text becomes U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_CHARS = 1 << 20

# Role names in the template and the escapes of control strings.
ROLES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
ESCAPES = {"\\": "\\\\", "</turn>": "\\/", "### ": "\\#"}
# Other names of the roles in message lists.
SAME_ROLE = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

# Declarative mappings: the fields that make up a layout, and how turns come from them.
# ``fields``: (role, paths joined by an empty line); ``each``: list path, role field, text field;
# ``row``: a record that is one turn itself; ``optional`` fields may be absent; ``parts``: the path of the
# elements where a message's content may be a list of texts or of objects with type and text.
LAYOUTS = [
    {"name": "turn_row", "paths": ["role", "text", "turn"], "row": ("role", "text")},
    {"name": "prompt", "paths": ["prompt", "response"], "optional": ["system"],
     "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "completion", "paths": ["completion", "prompt"], "optional": ["system"],
     "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])]},
    {"name": "question", "paths": ["answer", "question"], "optional": ["context"],
     "fields": [("user", ["context", "question"]), ("assistant", ["answer"])]},
    {"name": "instruction", "paths": ["instruction", "output"], "optional": ["input", "system"],
     "fields": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"name": "messages", "paths": ["messages", "messages[].content", "messages[].role"], "optional": ["messages[].name"],
     "parts": "messages[].content[]", "each": ("messages", "role", "content")},
    {"name": "conversations", "paths": ["conversations", "conversations[].from", "conversations[].value"],
     "optional": ["system"], "each": ("conversations", "from", "value"), "fields": [("system", ["system"])]},
    {"name": "nested_messages", "paths": ["data", "data.messages", "data.messages[].content", "data.messages[].role"],
     "parts": "data.messages[].content[]", "each": ("data.messages", "role", "content")},
]


def field_paths(value, at: str = "") -> set[str]:
    """All nested field paths of a JSON value; list elements that are no objects are paths too."""
    found = set()
    if isinstance(value, dict):
        for k, v in value.items():
            path = f"{at}.{k}" if at else k
            found |= {path} | field_paths(v, path)
    elif isinstance(value, list):
        for v in value:
            found |= field_paths(v, f"{at}[]") if isinstance(v, (dict, list)) else {f"{at}[]"}
    return found


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _registry() -> tuple[dict[str, dict], set[str]]:
    known, paths = {}, set()
    for layout in LAYOUTS:
        variants = [set(layout["paths"])]
        for extra in layout.get("optional", []):
            variants += [v | {extra} for v in variants]
        if "parts" in layout:
            part = layout["parts"]
            objects = {f"{part}.type", f"{part}.text"}
            variants += [v | more for v in variants for more in ({part}, objects, objects | {part})]
        if "each" in layout:  # an empty list has no elements to show their fields
            variants += [{p for p in v if not p.startswith(f"{layout['each'][0]}[]")} for v in variants]
        known |= {fingerprint(v): layout for v in variants}
        paths.update(*variants)
    return known, paths


REGISTRY, KNOWN_PATHS = _registry()


def _at(record, path: str):
    for k in path.split("."):
        record = record.get(k) if isinstance(record, dict) else None
    return record


_HALF = re.compile("[\ud800-\udfff]")


def _text(value) -> str:
    told = value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)
    return _HALF.sub("\ufffd", told)


def _content(value) -> str:
    """A message's text; the parts of a list are joined by an empty line."""
    if not isinstance(value, list):
        return _text(value)
    return "\n\n".join(_text(v["text"] if isinstance(v, dict) and isinstance(v.get("text"), str) else v) for v in value)


def _layout(record) -> tuple[dict | None, str | None]:
    paths = field_paths(record)
    layout = REGISTRY.get(fingerprint(paths)) or REGISTRY.get(fingerprint(paths & KNOWN_PATHS))
    if layout is not None and "each" in layout:
        messages = _at(record, layout["each"][0])
        if not (messages is None or isinstance(messages, list) and all(isinstance(m, dict) for m in messages)):
            layout = None
    if layout is None:
        return None, "unknown layout"
    other = paths - KNOWN_PATHS
    return layout, "other fields: " + ", ".join(sorted(other)) if other else None


def turns(record) -> tuple[str | None, list[tuple[str, str]]]:
    """Layout name (null if unknown) and canonical (role, text) turns of a record."""
    layout, _ = _layout(record)
    return (None, []) if layout is None else (layout["name"], _turns(record, layout))


def _turns(record, layout: dict) -> list[tuple[str, str]]:
    if "row" in layout:
        role, text = (_text(record[k]) for k in layout["row"])
        return [(role, text)]
    out = []
    for role, paths in layout.get("fields", []):
        parts = [_text(_at(record, p)) for p in paths if _at(record, p) not in (None, "")]
        if parts:
            out.append((role, "\n\n".join(parts)))
    if "each" in layout:
        path, role, text = layout["each"]
        for m in _at(record, path) or []:
            name = _text(m.get(role))
            out.append((SAME_ROLE.get(name, name), _content(m.get(text))))
    return out


def _read(record: str | None) -> tuple[str | None, list[tuple[str | None, str | None]], str | None]:
    """Layout, turns and reason of a JSON record; without a layout the record is its own text, role null."""
    try:
        value = json.loads(record) if record else None
        layout, reason = _layout(value)
        if layout is not None:
            return layout["name"], _turns(value, layout) or [(None, None)], reason
        reason = reason if record else "no record"
    except RecursionError:
        reason = "nested too deeply"
    except ValueError:
        reason = "malformed JSON"
    return None, [(None, record)], reason


def _turn_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, order, sub, layouts, roles, texts, reasons = [], [], [], [], [], [], []
        for i, (turn, record) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            layout, found, reason = _read(record)
            for k, (role, text) in enumerate(found):
                ids.append(i)
                order.append(turn)
                sub.append(k)
                layouts.append(layout)
                roles.append(role)
                texts.append(text)
                reasons.append(_HALF.sub("\ufffd", reason) if reason else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(order, pa.int64()), pa.array(sub, pa.int64()),
             pa.array(layouts, pa.string()), pa.array(roles, pa.string()), pa.array(texts, pa.string()),
             pa.array(reasons, pa.string())],
            ["conv_id", "turn", "sub", "layout", "role", "text", "reason"])


def canonical(records: DataFrame) -> DataFrame:
    """Turns of ``records`` (conv_id, turn: order of the records of a conversation, record: JSON).

    Columns conv_id, turn, sub, layout, role, text, reason; role null: a record without turns; reason: why it
    has no layout, or which of its fields the layout does not read."""
    rows = records.select(records["conv_id"], records["turn"].cast("long"), records["record"])
    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(_turn_task, f"conv_id {kind}, turn long, sub long, layout string, role string, text string, "
                           "reason string")


_CONTROL = re.compile("|".join(re.escape(c) for c in ESCAPES))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_BACK = {e[1]: c for c, e in ESCAPES.items()} | {"c": ":"}  # a colon is escaped in role names only
_ROLE_BACK = {v: k for k, v in ROLES.items()}
_HEAD = re.compile(r"### ([^:]*): ")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text) if "\\" in text else text


def _head(role: str) -> str:
    return f"### {ROLES[role] if role in ROLES else '=' + escape(role).replace(':', chr(92) + 'c')}: "


def _role(name: str) -> str:
    return unescape(name[1:]) if name[:1] == "=" else _ROLE_BACK[name]


class _Formatter:
    """Collects the turns of one conversation into parts."""

    def __init__(self, conv):
        self.conv, self.part, self.pieces, self.length, self.spans = conv, 0, [], 0, []

    def add(self, role: str, text: str) -> None:
        head, body = _head(role), escape(text)
        if role == "assistant":
            start = self.length + len(head)
            self.spans.append({"start": start, "end": start + len(body)})
        self.pieces += [head, body, "</turn>\n"]
        self.length += len(head) + len(body) + 8

    def row(self) -> tuple:
        made = (self.conv, self.part, "".join(self.pieces), self.spans)
        self.part, self.pieces, self.length, self.spans = self.part + 1, [], 0, []
        return made


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _format_task(kind: pa.DataType):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], _SPANS)],
                ["conv_id", "part", "formatted", "loss_spans"])

        now, rows, size = None, [], 0
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv != conv:
                    if now is not None:
                        rows.append(now.row())
                        size += len(rows[-1][2])
                    now = _Formatter(conv)
                elif now.length >= PART_CHARS:
                    rows.append(now.row())
                    size += len(rows[-1][2])
                if role is not None:
                    now.add(role, text)
                if size >= 4 * PART_CHARS:
                    yield out(rows)
                    rows, size = [], 0
        if now is not None:
            rows.append(now.row())
        yield out(rows)
    return write


def _arrow_kind(name: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32()}.get(name, pa.int64())


def formatted(turn_rows: DataFrame) -> DataFrame:
    """conv_id, part, formatted, loss_spans of canonical turns; parts in order make the conversation."""
    kind = turn_rows.schema["conv_id"].dataType.simpleString()
    rows = turn_rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "sub", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(
        _format_task(_arrow_kind(kind)),
        f"conv_id {kind}, part long, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) turns of a formatted part."""
    out = []
    for turn in text.split("</turn>\n")[:-1]:
        head = _HEAD.match(turn)
        out.append((_role(head[1]), unescape(turn[head.end():])))
    return out


def _read_task(kind: pa.DataType):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        now, state, rows = None, None, []
        for batch in batches:
            for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or now != conv:
                    if state is not None:
                        rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in spans:
                    masked = unescape(text[span["start"]:span["end"]])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(text)
                if len(rows) >= 4096:
                    yield out(rows)
                    rows = []
        if state is not None:
            rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        yield out(rows)
    return read


def read_back(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from formatted parts."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    rows = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.select("conv_id", "formatted", "loss_spans").mapInArrow(
        _read_task(_arrow_kind(kind)), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long")


def turn_records(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as JSON records, nulls kept as fields."""
    c = conversations
    body = F.struct(c["turn"].alias("turn"), c["role"].alias("role"), c["text"].alias("text"))
    return c.select(c["conv_id"], c["turn"], F.to_json(body, {"ignoreNullFields": "false"}).alias("record"))
