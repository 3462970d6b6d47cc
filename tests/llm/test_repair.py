import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricelens.llm import queries, repair
from .helpers import SF

SPACE = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
KEEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit) by the plain recurrence over (rows left, state), comparing whole audits."""
    best = {"": (0, ""), "a": (0, ""), "u": (2, "I"), "s": (4, "II")}
    for (_, role, _), fault in zip(rows[::-1], found[::-1]):
        here = {}
        for state in NEXT:
            options = [(best[state][0] + 3, "D" + best[state][1])]
            if fault in ("", "truncated"):
                extra, onward = int(fault == "truncated"), best[NEXT[state]]
                options.append((onward[0] + 2 + extra, "R" + onward[1]))
                if (state, role[:1]) in KEEP:
                    onward = best[KEEP[state, role[:1]]]
                    options.append((onward[0] + extra, "K" + onward[1]))
            here[state] = min(options)
        for _ in range(3):  # inserted rows before this one
            here = {s: min(here[s], (here[NEXT[s]][0] + 2, "I" + here[NEXT[s]][1])) for s in here}
        best = here
    return best[""]


def repaired(rows, audit):
    state, out, left = "", [], list(rows)
    for letter in audit:
        if letter == "D":
            left.pop(0)
            continue
        role, text = ("", "") if letter == "I" else left.pop(0)[1:]
        if letter == "K":
            state = KEEP[state, role[:1]]
        else:
            state = NEXT[state]
            role = {"u": "user", "a": "assistant"}[state]
        out.append((role, text))
    return out


def brute(conv, rows):
    """The result for one conversation's (turn, role, text) rows."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    found = faults(rows)
    cost, audit = cheapest(rows, found)
    turns = {t for t, *_ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    text = "\n".join(f"{r}:{x}" for r, x in repaired(rows, audit))
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
        here = out.setdefault(conv, [])
        here += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, part long, conv string")


ROLES = st.sampled_from(["system", "user", "assistant", "tool", "", " "])
TEXTS = st.sampled_from(["Yes.", "No!", "and then", " ", "", "Why?\n", "so\x85"])


def _plain(rows):
    found, out = faults(rows), []
    for (_, role, text), fault in zip(rows, found):
        out.append(repair.Row(role, text, 1, {"blank": repair.BLANK, "duplicate": repair.DUPLICATE,
                                              "truncated": repair.TRUNCATED, "": repair.FINE}[fault]))
    return found, out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.just(0), ROLES, TEXTS), max_size=14), st.integers(1, 5))
def test_chunks_from_speculative_vectors_give_the_least_audit(rows, size):
    marks, line = _plain(rows)
    cost, audit = cheapest(rows, marks)
    parts = [line[i:i + size] for i in range(0, len(line), size)] or [[]]
    codes = ["".join(repair.code(r) for r in p if r.live) for p in parts]
    end = [repair.END] * len(parts)
    start = [repair.backward(c, repair.END)[0] for c in codes]
    for k in range(len(parts) - 2, -1, -1):  # one fix-up pass from right to left
        start[k], _ = repair.fixed(codes[k], end[k], start[k + 1], start[k])
        end[k] = start[k + 1]
        assert start[k] == repair.backward(codes[k], end[k])[0]
    state, letters, paid = repair.NOTHING, "", 0
    for k, p in enumerate(parts):
        for letter, _, _, price in repair.edits(p, end[k], state, k == len(parts) - 1):
            letters, paid = letters + letter, paid + price
        state, _ = repair.trace(codes[k], repair.backward(codes[k], end[k]), state)
    assert (paid, letters) == (cost, audit)


def test_convergence_stops_the_rerun():
    codes = "SUA" + "UA" * 500
    _, done = repair.fixed(codes, repair.END, (9, 9, 0, 0), repair.backward(codes, repair.END)[0])
    assert done < 10


def conversations():
    rng = random.Random(8)
    texts = ["Yes.", "No!", "and then", " ", "", "Why?", "so on", "Well. ", None]
    rows = [(c, t, rng.choice(["system", "user", "assistant", "assistant", "user", "tool", None]),
             rng.choice(texts) if rng.random() < 0.5 else f"text {c} {t}.")
            for c in range(60) for t in range(rng.randrange(1, 9)) if rng.random() < 0.9]
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}" + ".!x"[t % 3]) for t in range(300)]  # a hot conversation
    rows += [(101, t, "tool", f"{t}.") for t in range(150)]  # nothing converges
    rows += [(102, t // 3, rng.choice(["user", "assistant"]), "the same.") for t in range(200)]
    rows += [(103, None, "user", "no turn."), (103, None, "system", "no turn"), (103, None, "system", "no turn"), (103, 4, "user", "no turn.")]
    rows += [(104, None, "user", "a."), (None, 1, "user", "no id."), (None, 7, "assistant", "long " * 20_000), (105, 0, "user", "x.")] + [(105, 0, "user", "x.")] * 40
    return rows


@pytest.mark.parametrize("size", [1024, 7])
def test_repair_equals_plain_recurrence(spark, size):
    rows = conversations()
    by = {}
    for conv, *r in rows:
        by.setdefault(conv, []).append(tuple(r))
    want = sorted((brute(c, r) for c, r in by.items()), key=repr)
    assert found(repair.repair(table(spark, rows).repartition(4), rows_of_chunk=size)) == want


def test_query_equals_plain_recurrence(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.conversation_repair(spark, SF)) == sorted((brute(c, r) for c, r in damaged(rows).items()), key=repr)


def test_damage_of_awkward_rows_and_dropped_conversations(spark):
    rows = conversations() + [(c, 0, "user", "gone.") for c in range(1000, 1100)]
    want = sorted((brute(c, r) for c, r in damaged(rows).items()), key=repr)
    assert any(w[7] == "" and w[8] == hashlib.sha256().hexdigest() for w in want)
    assert found(repair.repair(repair.damaged(table(spark, rows)), queries.F.col("copies"))) == want


def test_repaired_turns_alternate_and_empty_table(spark):
    got = {}
    for r in repair.repaired_turns(table(spark, conversations()), rows_of_chunk=20).orderBy("conv_id", "part", "place").collect():
        got.setdefault(r["conv_id"], []).append(r["role"][0])
    assert got and all("".join(x).removeprefix("s") == "ua" * (len("".join(x).removeprefix("s")) // 2) for x in got.values())
    assert repair.repair(table(spark, [])).count() == 0 and repair.repaired_turns(table(spark, [])).count() == 0
