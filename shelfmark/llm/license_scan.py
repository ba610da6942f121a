"""Licence scans: Aho-Corasick over words and over names, a shunting-yard parser for licence expressions.

One automaton runs over the words of a text and finds the base phrases and the phrases of licence
notices. Where a text holds a tag such as ``SPDX-License-Identifier:`` or ``licensed under``, a
second one finds tags and licence names; the expression that follows a tag is read with operator
stacks and evaluated: of alternatives the least restrictive, of joint licences the most
restrictive, and an exception loosens a strong copyleft.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import id_and_text

# The base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Phrases of licence notices, as words.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons zero": "cc0",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
}

#: How far a licence restricts: 0 hardly, 1 changes to the work itself, 2 all that builds on it, 3 no commercial use.
RESTRICTION = {
    "unlicense": 0, "cc0": 0, "mit": 0, "isc": 0, "bsd": 0, "zlib": 0, "bsl": 0, "apache": 0, "cc-by": 0,
    "mpl": 1, "epl": 1, "lgpl": 1, "cc-by-sa": 1, "gpl": 2, "agpl": 2, "cc-by-nc": 3,
}
#: What an exception loosens, and to what.
STRONG, LOOSENED = 2, 1

# Identifiers by family; versions and suffixes are added by rule.
_VERSIONS = {
    "apache": ["1.0", "1.1", "2.0"], "gpl": ["1.0", "2.0", "3.0"], "lgpl": ["2.0", "2.1", "3.0"], "agpl": ["1.0", "3.0"],
    "mpl": ["1.0", "1.1", "2.0"], "epl": ["1.0", "2.0"], "bsl": ["1.0"], "cc0": ["1.0"], "bsd": ["1-clause", "2-clause", "3-clause", "4-clause"],
    "cc-by": ["3.0", "4.0"], "cc-by-sa": ["3.0", "4.0"], "cc-by-nc": ["3.0", "4.0"],
}
_PLAIN = ["mit", "isc", "zlib", "unlicense", "apache", "gpl", "lgpl", "agpl", "mpl", "epl"]
_PROSE = {
    "mit license": "mit", "apache license": "apache", "bsd license": "bsd", "isc license": "isc", "zlib license": "zlib",
    "gnu general public license": "gpl", "general public license": "gpl", "gnu lesser general public license": "lgpl",
    "lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl",
    "eclipse public license": "epl", "boost software license": "bsl",
}
EXCEPTIONS = [
    "classpath-exception-2.0", "gcc-exception-2.0", "gcc-exception-3.1", "llvm-exception", "linux-syscall-note",
    "autoconf-exception-2.0", "autoconf-exception-3.0", "bison-exception-2.2", "font-exception-2.0", "openssl-exception",
]
#: Texts before an expression.
TAGS = [
    "spdx-license-identifier:", "license-expression:", "license:", "licence:", "licensed under", "released under",
    "distributed under", "available under",
]
#: How much a kind of evidence tells that a text is under a licence.
MENTION, NOTICE, TAG = 0.5, 0.8, 0.95
#: Bytes of normalised text that are searched at once.
SLICE = 1 << 20

_KEEP = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_FILLER = re.compile(r"[ \t,]*(?:(?:the|either|both|terms of|a|an)[ \t]+)*")
_AFTER_NAME = re.compile(r"(?:,?[ \t]+(?:(?:version|v)\.?[ \t]*)?[0-9]+(?:\.[0-9]+)*)?(?:\+|[ \t]+or[ \t]+(?:any[ \t]+)?later(?:[ \t]+version)?)?")
_OPERATOR = re.compile(r"(?:and/or|and|or|with)(?![a-z0-9.-])")
_WORD_END = re.compile(r"(?![a-z0-9])(?!-[a-z0-9])(?!\.[a-z0-9])")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def names() -> dict[str, str]:
    """Licence names in lower case, and their family."""
    found = {**_PROSE, **{name: name for name in _PLAIN}}
    for family, versions in _VERSIONS.items():
        for version in versions:
            found[f"{family}-{version}"] = family
            if family.endswith("gpl"):
                found |= {f"{family}-{version}-only": family, f"{family}-{version}-or-later": family}
            if family.startswith("cc"):
                found[f"{family.replace('-', ' ', 1)} {version}"] = family
    return found


@dataclass
class Value:
    """What a licence expression comes to."""

    labels: frozenset[str]
    restriction: int


def combined(operator: str, left: Value, right: Value) -> Value:
    labels = left.labels | right.labels
    if operator == "or":
        return Value(labels, min(left.restriction, right.restriction))
    if operator == "and":
        return Value(labels, max(left.restriction, right.restriction))
    return Value(left.labels, LOOSENED if left.restriction == STRONG else left.restriction)


def evaluate(tokens: list[str], families: dict[str, str]) -> Value | None:
    """Shunting-yard over names, exceptions, ``and``, ``or``, ``with`` and parentheses.

    ``with`` binds tighter than ``and``, ``and`` tighter than ``or``; operators of one kind from the
    left. None where the tokens are no expression: a side is missing, parentheses do not match, an
    exception stands elsewhere than after ``with``, or ``with`` is followed by something else.
    """
    values: list[Value] = []
    waiting: list[str] = []

    def reduce() -> None:
        right, left = values.pop(), values.pop()
        values.append(combined(waiting.pop(), left, right))

    want_value = True
    for token in tokens:
        after_with = bool(waiting) and waiting[-1] == "with" and want_value
        if token in PRECEDENCE:
            if want_value:
                return None
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[token]:
                reduce()
            waiting.append(token)
            want_value = True
        elif token == "(":
            if not want_value or after_with:
                return None
            waiting.append(token)
        elif token == ")":
            if want_value:
                return None
            while waiting and waiting[-1] != "(":
                reduce()
            if not waiting:
                return None
            waiting.pop()
        else:
            if not want_value or after_with != (token not in families):
                return None
            values.append(Value(frozenset(), 0) if after_with else Value(frozenset([families[token]]), RESTRICTION[families[token]]))
            want_value = False
    if want_value:
        return None
    while waiting:
        if waiting[-1] == "(":
            return None
        reduce()
    return values[0]


@dataclass
class Scan:
    """What a text holds; word places count from 0."""

    n_words: int = 0
    base: list[tuple[int, str]] = field(default_factory=list)
    notices: set[str] = field(default_factory=set)
    expressions: list[tuple[str, Value]] = field(default_factory=list)

    @property
    def base_labels(self) -> set[str]:
        return {label for _, label in self.base}

    @property
    def labels(self) -> set[str]:
        return self.base_labels.union(self.notices, *[value.labels for _, value in self.expressions])

    @property
    def score(self) -> float:
        doubt = (1 - MENTION) ** len(self.base_labels) * (1 - NOTICE) ** len(self.notices)
        return 1 - doubt * (1 - TAG) ** len({text for text, _ in self.expressions})

    @property
    def restriction(self) -> int | None:
        """The most restrictive of all expressions, and of the labels that no expression holds."""
        stated = frozenset().union(*[value.labels for _, value in self.expressions])
        found = [value.restriction for _, value in self.expressions] + [RESTRICTION[label] for label in self.labels - stated]
        return max(found, default=None)


class Scanner:
    """Both automata; one of each per worker."""

    def __init__(self) -> None:
        self.words = ahocorasick.Automaton()
        for phrase, label in NOTICES.items():
            self.words.add_word(f" {phrase} ", (False, len(phrase.split()), label))
        for phrase, label in BASE_PHRASES.items():
            self.words.add_word(f" {phrase} ", (True, len(phrase.split()), label))
        self.words.make_automaton()
        self.families = names()
        self.tagged = ahocorasick.Automaton()
        for text in [*TAGS, *self.families, *EXCEPTIONS]:
            self.tagged.add_word(text, text)
        self.tagged.make_automaton()

    def scan(self, text: str) -> Scan:
        found = Scan()
        data = text.encode()
        self._phrases(data.translate(_KEEP), found)
        lower = data.lower()
        if b"licen" in lower or b" under" in lower:  # every tag holds one of them
            self._expressions(lower.decode("latin-1"), found)
        return found

    def _phrases(self, data: bytes, found: Scan) -> None:
        """Words and phrases, slice by slice; a slice begins with the last words of the one before."""
        keep = max(len(phrase.split()) for phrase in [*NOTICES, *BASE_PHRASES]) - 1
        begin, last = 0, []
        while begin < len(data):
            end = data.find(b" ", begin + SLICE)
            end = len(data) if end < 0 else end
            words = data[begin:end].split()
            begin = end
            part = b" " + b" ".join([*last, *words]) + b" "
            blanks = None
            for at, (is_base, size, label) in self.words.iter(part.decode("latin-1")):
                if blanks is None:
                    blanks = np.flatnonzero(np.frombuffer(part, np.uint8) == 32)
                after = int(np.searchsorted(blanks, at))  # words of the part up to the end of the phrase
                if after <= len(last):
                    continue  # it ended in the slice before
                if is_base:
                    found.base.append((found.n_words - len(last) + after - size, label))
                else:
                    found.notices.add(label)
            found.n_words += len(words)
            last = (last + words)[-keep:] if len(words) < keep else words[-keep:]

    def _expressions(self, text: str, found: Scan) -> None:
        tags: list[int] = []
        longest: dict[int, str] = {}
        for at, item in self.tagged.iter(text):
            begin = at - len(item) + 1
            if begin and (text[begin - 1].isalnum() or text[begin - 1] == "-"):
                continue  # inside a word
            if item in TAGS:
                tags.append(at + 1)
            elif _WORD_END.match(text, at + 1) and len(item) > len(longest.get(begin, "")):
                longest[begin] = item
        for at in tags:
            tokens = self._tokens(text, at, longest)
            value = evaluate(tokens, self.families)
            if value is not None:
                found.expressions.append((" ".join(tokens), value))

    def _tokens(self, text: str, at: int, longest: dict[int, str]) -> list[str]:
        """The tokens after a tag, up to the first thing that cannot go on with the expression."""
        tokens: list[str] = []
        operator_at = None
        want_value, opened = True, 0
        while True:
            at = _FILLER.match(text, at).end()
            if want_value:
                if text.startswith("(", at):
                    tokens.append("(")
                    opened += 1
                    at += 1
                elif at in longest:
                    tokens.append(longest[at])
                    at = _AFTER_NAME.match(text, at + len(longest[at])).end()
                    want_value = False
                else:
                    break
            elif opened and text.startswith(")", at):
                tokens.append(")")
                opened -= 1
                at += 1
            elif (operator := _OPERATOR.match(text, at)) is not None:
                operator_at = len(tokens)
                tokens.append("or" if operator[0] == "and/or" else operator[0])
                at = operator.end()
                want_value = True
            else:
                break
        # "the MIT License and that is all": the operator belongs to the sentence.
        return tokens[:operator_at] if want_value and operator_at is not None and operator_at == len(tokens) - 1 else tokens


@functools.lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def scan_licences(docs: DataFrame) -> DataFrame:
    """Licences of every whole text.

    doc_id; ``n_words``; ``n_base`` places of base phrases, ``first_word`` and ``last_word`` of them
    (null where there is none); ``base_labels`` and ``labels``, distinct, sorted and comma-joined,
    '' where there is none; ``score``, how sure it is that a licence is stated, 0 without evidence;
    ``restriction`` of what the expressions come to (null without a licence); ``expressions`` in the
    order of the text. A null text counts as empty. Rows are scanned one by one, so repeated rows
    repeat; columns other than doc_id and text are not read. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner().scan
        for batch in batches:
            found = [scan(text.as_py()) for text in batch.column("text")]
            joined = lambda labels: ",".join(sorted(labels))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 pa.array([f.n_words for f in found], pa.int64()), pa.array([len(f.base) for f in found], pa.int64()),
                 pa.array([min((at for at, _ in f.base), default=None) for f in found], pa.int64()),
                 pa.array([max((at for at, _ in f.base), default=None) for f in found], pa.int64()),
                 pa.array([joined(f.base_labels) for f in found], pa.string()), pa.array([joined(f.labels) for f in found], pa.string()),
                 pa.array([f.score for f in found], pa.float64()), pa.array([f.restriction for f in found], pa.int32()),
                 pa.array([[text for text, _ in f.expressions] for f in found], pa.list_(pa.string()))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "restriction", "expressions"],
            )

    return id_and_text(docs).mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, restriction int, expressions array<string>"
    )


def digest(scanned: DataFrame) -> DataFrame:
    """The scan with its expressions as one string."""
    return scanned.withColumn("expressions", F.array_join("expressions", ";"))
