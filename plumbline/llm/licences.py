"""Licence scans: one Aho-Corasick pass finds phrases and identifier tags, a shunting-yard parser reads licence expressions.

Words are runs of ASCII letters and digits and of other than ASCII characters; a phrase is found where its words stand one after
another, whatever stands between them. Behind an identifier tag the rest of the line is read as an expression of licence ids with
`and`, `or`, `with` and parentheses (`with` binds closest, then `and`), and evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import texts, utf8

# The phrases of the contract.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Our own: notice phrases, and tags that an expression follows.
NOTICES = {
    "permission is hereby granted free of charge": "mit", "redistribution and use in source and binary forms": "bsd", "licensed under the apache license": "apache-2",
    "gnu general public license": "gpl", "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl",
    "creative commons attribution": "cc-by", "creative commons zero": "cc0", "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
TAGS = ("spdx license identifier",)
TAG_LINE = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
PART = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+:-]*|[()]")
BINDS = {"with": 3, "and": 2, "or": 1}
PERMISSIVE = ("mit", "apache-", "bsd", "isc", "zlib", "cc0", "unlicense", "cc-by-4", "cc-by-3", "0bsd")
WEIGHT_TAG, WEIGHT_BASE, WEIGHT_NOTICE = 1.0, 0.9, 0.7
TO_WORDS = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class Expression(NamedTuple):
    """The licence ids of an expression (one `with` an exception is one term), and whether it can be met with permissive
    licences only: of `or` either side, of `and` both."""
    ids: frozenset[str]
    permissive: bool
    term: bool


def parse(text: str) -> Expression | None:
    """The value of an expression, None if it is none. Comment ends (`*/`, `-->`) and what follows them are no part of it."""
    parts = PART.findall(text.split("*/")[0].split("-->")[0])
    output: list[Expression] = []
    waiting: list[str] = []

    def apply() -> bool:
        operator = waiting.pop()
        if operator == "(" or len(output) < 2:
            return False
        right, left = output.pop(), output.pop()
        if operator == "with":
            if not (left.term and right.term):
                return False
            output.append(Expression(frozenset({f"{min(left.ids)} with {min(right.ids)}"}), left.permissive, False))
        else:
            either = operator == "or"
            output.append(Expression(left.ids | right.ids, left.permissive | right.permissive if either else left.permissive & right.permissive, False))
        return True

    operand_next = True
    for part in map(str.lower, parts):
        if part == "(" and operand_next:
            waiting.append(part)
        elif part == ")" and not operand_next:
            while waiting and waiting[-1] != "(":
                if not apply():
                    return None
            if not waiting:
                return None
            waiting.pop()
        elif part in BINDS and not operand_next:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[part]:
                if not apply():
                    return None
            waiting.append(part)
            operand_next = True
        elif operand_next and part not in BINDS and part not in "()":
            output.append(Expression(frozenset({part}), part.startswith(PERMISSIVE), True))
            operand_next = False
        else:
            return None
    while waiting:
        if not apply():
            return None
    return output[0] if len(output) == 1 and not operand_next else None


def machine():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, **dict.fromkeys(TAGS, "")}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan_text(raw: bytes, automaton) -> tuple[int, list[tuple[int, str, str, bool]], list[tuple[str, bool, list[str], bool]]]:
    """Number of words; places (first word, phrase, label, base); expressions (text, valid, ids, permissive)."""
    words = raw.translate(TO_WORDS).split()
    line = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    places, counted, at, tagged = [], 0, 0, False
    for end, phrase in sorted((end - len(phrase) - 1, phrase) for end, phrase in automaton.iter(line)):
        counted, at = counted + line.count(" ", at, end), end
        if phrase in TAGS:
            tagged = True
        if phrase in BASE:
            places.append((counted, phrase, BASE[phrase], True))
        elif phrase in NOTICES:
            places.append((counted, phrase, NOTICES[phrase], False))
    expressions = []
    for m in TAG_LINE.finditer(raw) if tagged else ():
        text = m[1].decode("utf-8", "replace").strip()
        value = parse(text)
        expressions.append((text, value is not None, sorted(value.ids) if value else [], bool(value and value.permissive)))
    return len(words), places, expressions


SCAN = "n_words long, places array<struct<word: long, phrase: string, label: string, base: boolean>>, expressions array<struct<expression: string, valid: boolean, ids: array<string>, permissive: boolean>>"
PLACE = pa.struct([("word", pa.int64()), ("phrase", pa.string()), ("label", pa.string()), ("base", pa.bool_())])
EXPRESSION = pa.struct([("expression", pa.string()), ("valid", pa.bool_()), ("ids", pa.list_(pa.string())), ("permissive", pa.bool_())])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places and expressions of each whole text. Null and empty texts have no words; overlapping phrases all
    count; repeated rows each come back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = machine()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            found = [scan_text(data[a:b].tobytes(), automaton) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            places = [[dict(zip(("word", "phrase", "label", "base"), p)) for p in f[1]] for f in found]
            expressions = [[dict(zip(("expression", "valid", "ids", "permissive"), e)) for e in f[2]] for f in found]
            yield pa.record_batch([batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array(places, pa.list_(PLACE)), pa.array(expressions, pa.list_(EXPRESSION))],
                                  ["doc_id", "n_words", "places", "expressions"])

    return texts(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCAN}")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of scanned texts."""
    base = F.filter("places", lambda p: p["base"])
    at = F.transform(base, lambda p: p["word"])
    valid = F.filter("expressions", lambda e: e["valid"])
    ids = F.flatten(F.transform(valid, lambda e: e["ids"]))
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.when(F.size(valid) > 0, WEIGHT_TAG).when(F.size(base) > 0, WEIGHT_BASE).when(F.size("places") > 0, WEIGHT_NOTICE).otherwise(0.0)
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
                        listed(F.transform(base, lambda p: p["label"])).alias("base_labels"), listed(F.concat(F.transform("places", lambda p: p["label"]), ids)).alias("labels"), best.alias("score"))
