"""Licence scans: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser evaluates expressions.

A text's words are its runs of ASCII letters and digits and of non-ASCII characters, with A-Z lower-cased.  One
automaton over the words finds every place of every phrase, at word boundaries.  Identifier tags
("SPDX-License-Identifier:") are followed by an expression of licence ids joined with AND, OR, WITH and brackets, up
to the end of the line; it is parsed to postfix order and evaluated to the ids it needs.

Defined results: a null or empty text has no words, no place and score 0; an expression that doesn't parse gives no
label of its own; repeated rows get equal results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

# Base phrases with their labels, further phrases of the library, the tag.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
MORE = {
    "creative commons attribution": "cc-by", "lesser general public license": "lgpl", "affero general public license": "agpl",
    "mozilla public license": "mpl", "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit", "all rights reserved": "proprietary",
    "licensed under the apache": "apache", "cc0 1 0": "cc0", "public domain": "public-domain",
}
TAG = b"spdx-license-identifier:"
_TO_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20
                  for c in range(256))
_TOKEN = re.compile(rb"[()]|[a-z0-9][a-z0-9.+:-]*")
#: Precedence of the operators, higher binds closer (a fixed value of the expression language).
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def to_postfix(expression: str | Iterable[str]) -> list[str]:
    """Shunting-yard: an expression's tokens, lower-cased, in postfix order, up to the first that can't belong to it;
    ValueError where it doesn't parse."""
    tokens = (t[0].decode() for t in _TOKEN.finditer(expression.lower().encode())) if isinstance(expression, str) else expression
    out: list[str] = []
    waiting: list[str] = []
    want_id = True
    for t in tokens:
        if t in PRECEDENCE:
            if want_id:
                raise ValueError("an operator without a left side")
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[t]:
                out.append(waiting.pop())
            waiting.append(t)
            want_id = True
        elif t == "(":
            if not want_id:
                raise ValueError("a bracket after an id")
            waiting.append(t)
        elif t == ")":
            if want_id:
                raise ValueError("an empty bracket")
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ValueError("a bracket too many")
            waiting.pop()
        else:
            if not want_id:
                break  # plain text after the expression
            out.append(t)
            want_id = False
    if want_id or "(" in waiting:
        raise ValueError("an expression cut short")
    return out + waiting[::-1]


def evaluate(postfix: list[str]) -> list[frozenset[str]]:
    """The choices that fulfil an expression, each the set of ids it needs (an exception belongs to its id).  Every
    (a OR b) AND doubles them; labels, which need only their ids, come from `needed_ids`."""
    stack: list[list[frozenset[str]]] = []
    for t in postfix:
        if t not in PRECEDENCE:
            stack.append([frozenset([t])])
            continue
        right, left = stack.pop(), stack.pop()
        if t == "or":
            both = left + right
        elif t == "and":
            both = [a | b for a in left for b in right]
        else:
            both = [frozenset(f"{x}-with-{y}" for x in a for y in b) for a in left for b in right]
        stack.append(sorted(set(both), key=sorted))
    return stack[0]


def needed_ids(postfix: list[str]) -> set[str]:
    """The ids of all choices of an expression, in one pass; an exception must stand between two ids (else ValueError)."""
    ids: set[str] = set()
    stack: list[str | None] = []  # an id that an exception may still follow, or None
    for t in postfix:
        if t not in PRECEDENCE:
            stack.append(t)
            continue
        right, left = stack.pop(), stack.pop()
        if t == "with":
            if left is None or right is None:
                raise ValueError("an exception stands between two ids")
            ids.add(f"{left}-with-{right}")
        else:
            ids.update(x for x in (left, right) if x is not None)
        stack.append(None)
    return ids | {x for x in stack if x is not None}


def expression_labels(expression: str | Iterable[str]) -> set[str]:
    """Every id of an expression's choices; none if it doesn't parse."""
    try:
        return needed_ids(to_postfix(expression))
    except ValueError:
        return set()


def tagged_expressions(low: bytes) -> Iterator[set[str]]:
    """The ids of the expression after each tag of a lower-cased text.

    Expressions are read token by token and end at the line's end, the next tag, or the first token that can't belong
    to them; the search for tags goes on there, so a text is read once however many tags share a line."""
    tag, stop = low.find(TAG), -1
    while tag >= 0:
        start = tag + len(TAG)
        if stop < start:
            stop = low.find(b"\n", start)
            stop = stop if stop >= 0 else len(low)
        read = start

        def tokens() -> Iterator[str]:
            nonlocal read
            for t in _TOKEN.finditer(low, start, stop):
                if t[0] == TAG:
                    return
                read = t.end()
                yield t[0].decode()

        yield expression_labels(tokens())
        tag = low.find(TAG, read)


@lru_cache(maxsize=1)
def machine() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in {**BASE, **MORE}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan(text: bytes) -> tuple[int, int, int | None, int | None, list[str], list[str], float]:
    """(words, base places, first and last word of a base place, base labels, all labels, score) of one text."""
    words = text.translate(_TO_WORDS).split()
    line = " " + b" ".join(words).decode("latin-1") + " "
    places, base, labels = [], set(), set()
    at = word = 0
    for end, phrase in machine().iter(line):
        start = end - len(phrase) - 1
        if phrase in BASE:
            word += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
            at = start
            places.append(word)
            base.add(BASE[phrase])
        labels.add(BASE.get(phrase) or MORE[phrase])
    found = 0
    for ids in tagged_expressions(text.lower()):
        labels |= ids
        found += bool(ids)
    evidence = len(places) + 2 * found + 0.5 * len(labels - base)
    score = 1 - math.exp(-evidence) if evidence else 0.0
    return (len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(base | labels), score)


_COLUMNS = [("n_words", "long", pa.int64()), ("n_base", "long", pa.int64()), ("first_word", "long", pa.int64()),
            ("last_word", "long", pa.int64()), ("base_labels", "array<string>", pa.list_(pa.string())),
            ("labels", "array<string>", pa.list_(pa.string())), ("score", "double", pa.float64())]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan(t) for t in batch.column("text").to_pylist()]
        cols = [pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(_COLUMNS)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[batch.schema.names[0], *(n for n, _, _ in _COLUMNS)])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels (arrays) and score (0 to 1)."""
    rows = docs.select(F.col(id_col), as_bytes(text_col).alias("text"))
    columns = [f"`{id_col}` {dict(rows.dtypes)[id_col]}", *(f"{name} {kind}" for name, kind, _ in _COLUMNS)]
    return rows.mapInArrow(_scan, ", ".join(columns))
