"""Licence scan: Aho-Corasick over notices and tags, shunting-yard over expressions.

*Notices.* A text's words (see ``common.words``) are joined by single spaces and one automaton
finds every phrase at word boundaries, overlapping ones too.  The three base phrases
give the places that are counted; the further phrases only add labels.

*Tags.* A second automaton finds identifier tags (``SPDX-License-Identifier:`` and the like)
in the lower-cased text itself.  The rest of the tag's line is tokenised and a shunting-yard
parser turns ``AND`` / ``OR`` / ``WITH`` and parentheses into an evaluated expression: the set of
alternatives, each the set of licences that must be met together.  An expression whose alternatives
would take over ``EXPANDED_NAMES`` names is told as it was parsed, in its factors, which says the same.
All named licences are labels; an expression that does not parse gives the licences up to the
error.  Tags are read as ASCII, without a full stop, colon or dash at the end of a name.

The score is the share of evidence: tags count 1, further phrases 0.8, base places 0.5, combined
as independent hints.

Cases: a null text is an empty one, without words and labels and with score 0; overlapping
and repeated phrases all count; equal rows give equal results; the text is scanned in
one pass whatever its length; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

# Base phrases and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Further notice phrases and their labels.
FURTHER = {
    "apache license": "apache",
    "mit license": "mit",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
# Tags before a licence expression.
TAGS = ("spdx-license-identifier:", "license-identifier:", "license-expression:")
WEIGHTS = {"tag": 1.0, "further": 0.8, "base": 0.5}

_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?")  # no full stop at the end
_LINE = re.compile(r"[^\r\n]*")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_SYNTAX = frozenset(("(", ")", "and", "or"))
EXPANDED_NAMES = 1024


@lru_cache(maxsize=1)
def _automata():
    notices, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("further", FURTHER)):
        for phrase, label in phrases.items():
            key = f" {phrase} "
            notices.add_word(key, (len(key), kind, label))
    for tag in TAGS:
        tags.add_word(tag, len(tag))
    notices.make_automaton()
    tags.make_automaton()
    return notices, tags


class Expression(NamedTuple):
    """A parsed expression: its loosest operator (none for one licence), its tokens with the parentheses it
    needs, and its alternatives, null where writing them out would take over ``EXPANDED_NAMES`` names."""
    operator: str
    tokens: deque
    alternatives: frozenset[frozenset[str]] | None

    @property
    def names(self) -> set[str]:
        return {t for t in self.tokens if t not in _SYNTAX}

    def told(self) -> str:
        if self.alternatives is None:
            return " ".join(self.tokens).replace("( ", "(").replace(" )", ")")
        return " or ".join(sorted(" and ".join(sorted(a)) for a in self.alternatives))


def _small(alternatives: frozenset) -> frozenset | None:
    return alternatives if sum(map(len, alternatives)) <= EXPANDED_NAMES else None


def _combine(op: str, left: Expression, right: Expression) -> Expression:
    if op == "with":
        exception = "-".join(sorted(right.names))
        name = lambda x: f"{x}-with-{exception}"
        tokens = deque(t if t in _SYNTAX else name(t) for t in left.tokens)
        known = left.alternatives
        return Expression(left.operator, tokens, known and frozenset(frozenset(map(name, a)) for a in known))
    for side in (left, right):
        if op == "and" and side.operator == "or":
            side.tokens.appendleft("(")
            side.tokens.append(")")
    if len(left.tokens) >= len(right.tokens):  # the shorter side moves, so long chains cost n log n
        tokens = left.tokens
        tokens.append(op)
        tokens.extend(right.tokens)
    else:
        tokens = right.tokens
        tokens.appendleft(op)
        tokens.extendleft(reversed(left.tokens))
    one, other = left.alternatives, right.alternatives
    if one is None or other is None:
        both = None
    elif op == "or":
        both = _small(one | other)
    else:
        large = sum(map(len, one)) * len(other) + sum(map(len, other)) * len(one) > 16 * EXPANDED_NAMES
        both = None if large else _small(frozenset(a | b for a in one for b in other))
    return Expression(op, tokens, both)


def parse(expression: str) -> Expression | None:
    """The licence expression, null if there is none.

    ``WITH`` binds an exception to its licence, ``AND`` binds tighter than ``OR``.  Reading
    stops at the first token that fits nowhere."""
    output: list[Expression] = []
    operators: list[str] = []
    opened = 0

    def apply(op: str) -> None:
        right, left = output.pop(), output.pop()
        output.append(_combine(op, left, right))

    operand_next = True
    for token in _TOKEN.finditer(expression):
        word = token[0].lower()
        if operand_next:
            if word == "(":
                operators.append(word)
                opened += 1
            elif word in _SYNTAX or word in _PRECEDENCE:
                break
            else:
                output.append(Expression("", deque([word]), frozenset([frozenset([word])])))
                operand_next = False
        elif word in _PRECEDENCE:
            while operators and operators[-1] != "(" and _PRECEDENCE[operators[-1]] >= _PRECEDENCE[word]:
                apply(operators.pop())
            operators.append(word)
            operand_next = True
        elif word == ")" and opened:
            while operators[-1] != "(":
                apply(operators.pop())
            operators.pop()
            opened -= 1
        else:
            break
    if operand_next and operators:  # an operator without its right side
        while operators and operators[-1] == "(":
            operators.pop()
        if operators:
            operators.pop()
    for op in reversed(operators):
        if op != "(" and len(output) >= 2:
            apply(op)
    while len(output) >= 2:
        apply("or")
    return output[0] if output else None


def evaluate(expression: str) -> frozenset[frozenset[str]] | None:
    """The alternatives of a licence expression, each the licences that hold together; null where they are too
    many to write out (``parse`` keeps the expression)."""
    parsed = parse(expression)
    return parsed.alternatives if parsed else frozenset()


def _expressions(text: bytes) -> list[Expression]:
    lowered = text.lower()
    if b"license-" not in lowered:
        return []
    _, tags = _automata()
    plain, lowered = text.decode("latin-1"), lowered.decode("latin-1")
    found, after = [], -1
    for end, _ in tags.iter(lowered):
        if end > after:  # a longer tag may end where a shorter one does
            found.append(parse(_LINE.match(plain, end + 1)[0]))
            after = end
    return [f for f in found if f]


def scan_one(text: bytes | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions."""
    found = common.words(text)
    joined = (b" " + b" ".join(found) + b" ").decode("latin-1") if found else ""
    notices, _ = _automata()
    n_base, first, last, base, labels, doubt = 0, None, None, set(), set(), 1.0
    at, word = 0, -1  # words begun before position ``at``
    starts = []
    for end, (length, kind, label) in notices.iter(joined):
        labels.add(label)
        doubt *= 1 - WEIGHTS[kind]
        if kind == "base":
            n_base += 1
            base.add(label)
            starts.append(end - length + 1)
    for start in sorted(starts):
        word += joined.count(" ", at, start + 1)
        at = start + 1
        first = word if first is None else first
        last = word
    expressions = _expressions(text) if text else []
    for e in expressions:
        doubt *= 1 - WEIGHTS["tag"]
        labels |= e.names
    told = [e.told() for e in expressions]
    return (len(found), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - doubt, told)


_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
          pa.list_(pa.string()))
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions"]


def _scan_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan_one(t) for t in common.utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS))],
            ["doc_id", *_NAMES])


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions: a row a document."""
    docs = documents.select(documents["doc_id"], documents["text"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        _scan_task, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double, expressions array<string>")
