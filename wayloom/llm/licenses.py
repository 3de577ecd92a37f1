"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser reads expressions.

Notice phrases are found in the word form of a text (lower-cased words joined by one space), so that punctuation and
line breaks between the words do not matter; all places count, overlapping ones too. Identifier tags
(``SPDX-License-Identifier:``) are found in the same pass; the rest of their line is an expression of licence names,
``AND``, ``OR``, ``WITH`` and brackets. It is turned into postfix form by precedence (WITH over AND over OR) and
evaluated twice: to the set of names it holds, and to whether a set of accepted licences satisfies it.

Defined results: null and empty texts have no words, no labels and score 0; a malformed expression gives the names it
holds and counts as not satisfied; rows are judged one by one, so repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import PLAIN_WORDS

#: Phrases of the contract with their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further phrases: label and how sure a single place makes us.
NOTICE_PHRASES = {
    "gnu general public license version 3": ("gpl-3", 0.9),
    "gnu general public license version 2": ("gpl-2", 0.9),
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "creative commons attribution": ("cc-by", 0.6),
    "all rights reserved": ("all-rights-reserved", 0.4),
}
TAG = "spdx license identifier"
TAG_LINE = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
BASE_SURE, TAG_SURE = 0.9, 0.95
ACCEPTED = frozenset({"mit", "apache-2", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc"})
STRENGTH = {"or": 1, "and": 2, "with": 3}
#: Names of the identifier list that mean a label of the phrases.
SAME_AS = {"apache-2.0": "apache-2", "gpl-3.0": "gpl-3", "gpl-3.0-only": "gpl-3", "gpl-3.0-or-later": "gpl-3", "gpl-2.0": "gpl-2"}


@dataclass(frozen=True)
class Expression:
    names: tuple[str, ...]
    well_formed: bool
    satisfied: bool


def to_postfix(text: str) -> list[str] | None:
    """Postfix form of an expression, None if it is malformed."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in re.findall(r"[()]|[a-z0-9.+\-:]+", text.lower()):
        if token == "(":
            if not operand_next:
                return None
            waiting.append(token)
        elif token == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif token in STRENGTH:
            if operand_next:
                return None
            while waiting and STRENGTH.get(waiting[-1], 0) >= STRENGTH[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(text: str, accepted: Iterable[str] = ACCEPTED) -> Expression:
    """Names in the expression, and whether ``accepted`` satisfies it; an exception (WITH) does not take rights away."""
    allowed = set(accepted)
    postfix = to_postfix(text)
    words = [t for t in re.findall(r"[a-z0-9.+\-:]+", text.lower()) if t not in STRENGTH]
    if postfix is None:
        return Expression(tuple(sorted(set(words))), False, False)
    names: set[str] = set()
    stack: list[tuple[bool, bool]] = []  # (satisfied, is an exception name so far)
    for token in postfix:
        if token in STRENGTH:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left[0], False))
            else:
                stack.append((left[0] and right[0] if token == "and" else left[0] or right[0], False))
        else:
            names.add(token)
            stack.append((token in allowed, False))
    return Expression(tuple(sorted(names)), True, stack[0][0])


def automaton() -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for phrase, label in BASE_PHRASES.items():
        built.add_word(f" {phrase} ", (phrase.count(" ") + 1, label, True, BASE_SURE))
    for phrase, (label, sure) in NOTICE_PHRASES.items():
        built.add_word(f" {phrase} ", (phrase.count(" ") + 1, label, False, sure))
    built.add_word(f" {TAG} ", (3, None, False, TAG_SURE))
    built.make_automaton()
    return built


def scan_text(text: str | None, built: ahocorasick.Automaton) -> dict:
    """All finds of one text."""
    words = (text or "").encode().translate(PLAIN_WORDS).split()
    line = f" {b' '.join(words).decode()} "
    starts: list[int] = []
    base, labels, doubt, tagged = set(), set(), 1.0, False
    seen = at = 0
    for end, (length, label, is_base, sure) in built.iter(line):
        seen += line.count(" ", at, end)  # words that end before this place
        at = end
        doubt *= 1.0 - sure
        if label is None:
            tagged = True
            continue
        labels.add(label)
        if is_base:
            base.add(label)
            starts.append(seen - length)
    expressions = [evaluate(m[1]) for m in TAG_LINE.finditer(text)] if tagged and text else []
    for expression in expressions:
        labels.update(SAME_AS.get(n, n) for n in expression.names)
    return {
        "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": 1.0 - doubt,
        "n_tags": len(expressions), "permitted": all(e.satisfied for e in expressions) if expressions else None,
    }


RESULT = pa.schema(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
     ("labels", pa.string()), ("score", pa.float64()), ("n_tags", pa.int64()), ("permitted", pa.bool_())]
)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col and the finds of ``scan_text``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = automaton()
        for batch in batches:
            found = pa.RecordBatch.from_pylist([scan_text(t.as_py(), built) for t in batch.column(1)], RESULT)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], [id_col, *RESULT.names])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(
        scan,
        f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_tags long, permitted boolean",
    )
