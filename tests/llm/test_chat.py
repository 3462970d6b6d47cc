import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from pricelens.llm import chat

PARTS = st.sampled_from(list("\\/#<>turn: ce\n=é") + ["</turn>", "### ", "### Assistant: ", "</turn>\n"])
TEXT = st.lists(PARTS, max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "Odd: role", "=x", "\\c"]) | TEXT, TEXT), max_size=6))
def test_template_is_reversible(turns):
    f = chat._Formatter(1)
    for role, text in turns:
        f.add(role, text)
    _, _, out, spans = f.row()
    assert chat.parse(out) == turns
    assert [chat.unescape(out[s["start"]:s["end"]]) for s in spans] == [t for r, t in turns if r == "assistant"]


def test_layouts_are_found_by_fingerprint(spark):
    records = [
        ({"prompt": "p", "response": "r"}, "prompt", [("user", "p"), ("assistant", "r")]),
        ({"system": "s", "prompt": "p", "completion": "r"}, "completion", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
        ({"instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, "messages",
         [("user", "a"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "conversations",
         [("user", "a"), ("assistant", "b")]),
        ({"data": {"messages": [{"role": "user", "content": "a"}]}}, "nested_messages", [("user", "a")]),
        ({"who": "knows"}, None, []),
    ]
    df = spark.createDataFrame([(i, 0, json.dumps(r), 7) for i, (r, *_) in enumerate(records)],
                               "conv_id long, turn int, record string, layout int")
    got = {}
    for r in chat.canonical(df).orderBy("conv_id", "sub").collect():
        got.setdefault(r["conv_id"], (r["layout"], []))[1].extend([(r["role"], r["text"])] if r["role"] is not None else [])
    assert got == {i: (layout, turns) for i, (_, layout, turns) in enumerate(records)}


def test_awkward_rows_and_parts(spark, monkeypatch):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, 0, "user", "x"), (2, None, "assistant", "null turn"),
            (2, 0, None, "no role"), (3, 0, "user", "tie b"), (3, 0, "user", "tie a"), (3, 0, "user", "tie a"),
            (4, 0, "assistant", ""), *[(5, i, "assistant" if i % 2 else "user", f"</turn>{i}" * 20_000) for i in range(40)]]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "conv_id long, turn long, role string, text string, part int, layout string")
    parts = chat.formatted(chat.canonical(chat.turn_records(df)))
    assert parts.where("conv_id = 5").count() > 1  # cut between turns
    got = {r["conv_id"]: r for r in chat.read_back(parts).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        told = "".join(f"{role}\n{text}\n" for *_, role, text in own)
        loss = "".join(text for *_, role, text in own if role == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (
            len(own), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.formatted(chat.canonical(chat.turn_records(df.limit(0))))).count() == 0


def test_no_record_crashes_or_is_lost(spark):
    one = {"role": "user", "content": "a"}
    cases = [
        ('{"prompt": "p", ', None, [(None, '{"prompt": "p", ')], "malformed JSON"),
        (json.dumps({"messages": [one, "x"]}), None, [(None, None)], "unknown layout"),
        (json.dumps({"messages": "text"}), None, [(None, None)], "unknown layout"),
        (json.dumps({"messages": one}), None, [(None, None)], "unknown layout"),
        (json.dumps({"messages": None}), "messages", [(None, None)], None),
        (json.dumps({"messages": []}), "messages", [(None, None)], None),
        (json.dumps({"prompt": "p", "response": "r", "id": 5, "meta": {"a": 1}}), "prompt",
         [("user", "p"), ("assistant", "r")], "other fields: id, meta, meta.a"),
        (json.dumps({"messages": [{**one, "tool_calls": []}]}), "messages", [("user", "a")], "other fields: messages[].tool_calls"),
        (json.dumps({"messages": [{"role": "user", "content": ["a", {"type": "text", "text": "b"}]}, one]}), "messages",
         [("user", "a\n\nb"), ("user", "a")], None),
        (json.dumps({"messages": [{"role": "user", "content": [{"type": "image"}]}]}), None, [(None, None)], "unknown layout"),
        ('{"prompt": "half \\ud800", "response": "\\ud83d\\ude00"}', "prompt",
         [("user", "half \ufffd"), ("assistant", "\U0001F600")], None),
        ("[" * 100_000 + "]" * 100_000, None, [(None, None)], "nested too deeply"),
        (None, None, [(None, None)], "no record"), ("", None, [(None, "")], "no record"),
        ("null", None, [(None, "null")], "unknown layout"), ("[1, 2]", None, [(None, "[1, 2]")], "unknown layout"),
    ]
    df = spark.createDataFrame([(i, None, r, "z") for i, (r, *_) in enumerate(cases)],
                               "conv_id long, turn int, record string, reason string")
    rows = chat.canonical(df).orderBy("conv_id", "sub").collect()
    for i, (record, layout, turns, reason) in enumerate(cases):
        got = [r for r in rows if r["conv_id"] == i]
        kept = [(None, record)] if layout is None else turns
        assert [(r["role"], r["text"]) for r in got] == kept, record
        assert {r["layout"] for r in got} == {layout} and {r["reason"] for r in got} == {reason}, record
    assert chat.formatted(chat.canonical(df)).count() == len(cases)
