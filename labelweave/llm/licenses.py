"""Licence notices recognised by sentence rules."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col

_END = re.compile(r"(?:(?<=[.!?;:])(?=\s)|[\r\n]+|(?<=[.!?;:])[\"')\]]+(?=\s))")
_BREAK = re.compile(r"\r*\n|\r")
_NOT_WORD = re.compile(r"[\W_]+")
#: What may stand before a sentence in its line: a list number, or a comment mark that is a word.
_NUMBER = r"(?:\d+(?:\.\d+)*|[a-z]|[ivx]+)[.)\]]+"
_LEAD = re.compile(rf"[\W_]*(?:(?:dnl|rem|c)(?=\s|$)(?:[\W_]*{_NUMBER})?|{_NUMBER})\s*", re.IGNORECASE)
_BULLET = re.compile(r"[\s*#/;%]*[-+•‣◦]\s")


@dataclass(frozen=True)
class Rule:
    """Sentences that must follow one another; up to ``gap`` unknown sentences may stand between two of them."""

    licence: str
    sentences: tuple[str, ...]
    gap: int = 1


# Sentences of published licence notices.
RULES = (
    Rule("MIT", ("Released under the MIT License.",)),
    Rule("MIT", ("Licensed under the MIT License.",)),
    Rule("MIT", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    )),
    Rule("Apache-2.0", ("Licensed under the Apache License, Version 2.0.",)),
    Rule("Apache-2.0", (
        "Licensed under the Apache License, Version 2.0 (the \"License\");",
        "you may not use this file except in compliance with the License.",
    )),
    Rule("GPL-3.0", ("This work is licensed under the GNU General Public License, version 3.",)),
    Rule("GPL-3.0-or-later", (
        "This program is free software:",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version.",
    )),
    Rule("CC-BY-NC-4.0", ("Licensed under CC BY-NC 4.0.",)),
    Rule("CC-BY-4.0", ("Licensed under CC BY 4.0.",)),
    Rule("CC-BY-4.0", ("This work is licensed under a Creative Commons Attribution 4.0 International License.",)),
    Rule("BSD-3-Clause", (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission.",
    ), 4),
)


def normalised(sentence: str) -> str:
    """Lower-case words and digits, one space between them."""
    return _NOT_WORD.sub(" ", sentence).strip().lower()


class Piece(NamedTuple):
    """Words of one line, up to an end mark. ``joined``: one line break, no end mark, parts it from the piece before."""

    start: int
    end: int
    words: str
    joined: bool


def pieces(text: str) -> Iterator[Piece]:
    """The pieces of a text that have words; a line without any, such as a bare comment mark, is a blank line."""
    start, breaks, ended = 0, 0, True
    for m in [*_END.finditer(text), None]:
        end, following = (m.start(), m.end()) if m else (len(text), len(text))
        line = m is not None and text[end:following][:1] in ("\r", "\n")
        sentence = text[start:end].strip()
        words = normalised(sentence) if sentence else ""
        if words:
            at = text.index(sentence, start)
            yield Piece(at, at + len(sentence), words, not ended and breaks == 1)
            breaks, ended = 0, not line
        if line:
            breaks += 1 if following - end == 1 else len(_BREAK.findall(text, end, following))
        start = max(start, following)


class Known(NamedTuple):
    """A known sentence in a text: its first and last piece, characters and identifier."""

    first: int
    last: int
    start: int
    end: int
    sentence: int


class Matcher:
    """Known sentences by identifier, and the rules over them."""

    def __init__(self, rules: Sequence[Rule] = RULES) -> None:
        self.ids: dict[str, int] = {}
        self.starting: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        self.rules = tuple(rules)
        for at, rule in enumerate(self.rules):
            sequence = tuple(self.ids.setdefault(normalised(s), len(self.ids)) for s in rule.sentences)
            self.starting.setdefault(sequence[0], []).append((at, sequence))
        split = [s.split(" ") for s in self.ids]
        self.beginnings = {" ".join(words[:n]) for words in split for n in range(1, len(words) + 1)}

    def identify(self, text: str, parts: Sequence[Piece]) -> list[Known]:
        """The known sentences, each of one piece or of several joined ones, in the order of their first pieces."""
        out = []
        for i, part in enumerate(parts):
            words, start = part.words, part.start
            if words not in self.beginnings:
                lead = _LEAD.match(text, part.start, part.end)
                words, start = (normalised(text[lead.end() : part.end]), lead.end()) if lead else ("", start)
            last = i
            while words in self.beginnings:
                if words in self.ids:
                    out.append(Known(i, last, start, parts[last].end, self.ids[words]))
                last += 1
                if last == len(parts) or not parts[last].joined:
                    break
                longer = f"{words} {parts[last].words}"
                if longer not in self.beginnings and (lead := _LEAD.match(text, parts[last].start, parts[last].end)):
                    longer = f"{words} {normalised(text[lead.end() : parts[last].end])}"
                words = longer
        return out

    def find(self, text: str) -> list[tuple[str, int, int, int]]:
        """(licence, rule, start, end) of each place where a rule's sentences follow in order."""
        parts = list(pieces(text))
        known = self.identify(text, parts)
        places: dict[int, list[Known]] = {}
        for k in known:
            places.setdefault(k.sentence, []).append(k)
        between = None
        out = []
        for k in known:
            for at, sequence in self.starting.get(k.sentence, ()):
                if len(sequence) > 1 and between is None:
                    between = _Between(text, parts)
                end = _follow(k, sequence[1:], places, between, self.rules[at].gap)
                if end is not None:
                    out.append((self.rules[at].licence, at, k.start, end))
        return out


class _Between:
    """How many sentences stand between two pieces. A list item begins one; a bare list number is none."""

    def __init__(self, text: str, parts: Sequence[Piece]) -> None:
        self.bare, self.begun = [], []
        begun, ended = 0, True
        for part in parts:
            lead = _LEAD.match(text, part.start, part.end)
            self.bare.append(lead is not None and lead.end() == part.end)
            if self.bare[-1]:
                ended = True
            else:
                item = lead and lead[0].rstrip()[-1] in ".)]" or _BULLET.match(text, part.start, part.end)
                begun += ended or not part.joined or bool(item)
                ended = False
            self.begun.append(begun)

    def __call__(self, last: int, first: int) -> int:
        if first - last < 2:
            return 0
        rest = self.begun[last + 1] == self.begun[last] and not self.bare[last + 1]
        return self.begun[first - 1] - self.begun[last] + rest


def _follow(
    known: Known, wanted: Sequence[int], places: dict[int, list[Known]], between: _Between | None, gap: int
) -> int | None:
    for sentence in wanted:
        later = places.get(sentence, [])
        at = bisect_right(later, known.last, key=lambda k: k.first)
        if at == len(later) or between(known.last, later[at].first) > gap:
            return None
        known = later[at]
    return known.end


def license_notices(
    docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, licence, rule, start, end): every notice in every document, by character offsets into the text.

    A sentence ends at an end mark before white space, at a blank line, or where a list item begins. Single line breaks,
    with the comment marks and list numbers beside them, are white space inside it; a known sentence may also begin
    or end with a line.

    - Missing and empty texts have no notices.
    - A sentence may belong to several rules; each match is a row, in each row of ``docs`` that has it.
    - An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(rules)
        for batch in batches:
            found = [(i, *m) for i, v in enumerate(batch.column(1)) for m in matcher.find(v.as_py() or "")]
            columns = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()),
                 *[pa.array(c, pa.int32()) for c in columns[2:]]],
                ["doc_id", "licence", "rule", "start", "end"],
            )

    narrow = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, licence string, rule int, start int, end int")
