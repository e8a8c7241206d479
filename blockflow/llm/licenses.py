"""License scans by template-markup matching.

A template is the wording of a license or of its notice with markup::

    [[ ... ]]        optional region, may be left out (may be nested)
    {{name}}         replaceable region: 1 to REPLACE words of any text
    {{name|a|b}}     replaceable region: one of the given wordings

Everything else is mandatory.  Texts and templates are read as words
(``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z), so punctuation
and line breaks never matter.  Each template is compiled to an automaton over
words (states are bits of an integer; optional regions are skips, replaceable
ones wildcard steps) that accepts a stretch of the text only when all its
mandatory words match exactly.  From each place where it can begin the
longest accepted stretch is taken, inside a match of the same template none
is begun.

A template whose longest run of mandatory words does not occur in a text
cannot match there; only templates passing this test are run.  The scan is one
pass without a shuffle; a text costs its length times the length of the few
templates that pass, whatever the number of matches.

Defined cases: a null or empty text has no words, no labels, score 0; repeated
rows are scanned alike.  The score is the share of the words that lie inside
accepted stretches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_text, sliced, table
from .license_texts import FULL

REPLACE = 12
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}

# The base phrases and their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Short notices that name a license (label, template); ``license_texts.FULL`` has the wordings themselves.
TEMPLATES = (
    ("mit", "{{verb|licensed|released|distributed|available|published}} under the [[terms of the]] mit license"),
    ("apache-2", "[[{{verb|licensed|released|distributed|available}}]] [[under]] [[the]] apache license version {{v|2 0|2}} [[the license]]"),
    ("apache-2", """you may not use this file except in compliance with the license you may obtain a copy of the license at
        [[http www apache org licenses license 2 0]] [[https www apache org licenses license 2 0]]"""),
    ("gpl-2", "{{verb|licensed|released|distributed}} under the [[terms of the]] [[gnu]] {{name|general public license|gpl}} [[version]] {{v|2|v2|2 0}} [[only]] [[or later]]"),
    ("gpl-3", "{{verb|licensed|released|distributed}} under the [[terms of the]] [[gnu]] {{name|general public license|gpl}} [[version]] {{v|3|v3|3 0}} [[only]] [[or later]]"),
    ("lgpl-2.1", "{{verb|licensed|released|distributed}} under the [[terms of the]] [[gnu]] {{name|lesser general public license|lgpl}} [[version]] {{v|2 1|v2 1}} [[only]] [[or later]]"),
    ("lgpl-3", "{{verb|licensed|released|distributed}} under the [[terms of the]] [[gnu]] {{name|lesser general public license|lgpl}} [[version]] {{v|3|v3|3 0}} [[only]] [[or later]]"),
    ("agpl-3", "{{verb|licensed|released|distributed}} under the [[terms of the]] [[gnu]] {{name|affero general public license|agpl}} [[version]] {{v|3|v3|3 0}} [[only]] [[or later]]"),
    ("gpl-2", """you can redistribute it and or modify it under the terms of the gnu general public license as published by the
        free software foundation either version 2 of the license or at your option any later version"""),
    ("gpl-3", """you can redistribute it and or modify it under the terms of the gnu general public license as published by the
        free software foundation either version 3 of the license or at your option any later version"""),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "under the [[terms of the]] mozilla public license [[version]] {{v|2 0|2}}"),
    ("bsd", "{{verb|licensed|released|distributed}} under [[the]] [[a]] bsd license"),
    ("bsd-2", "{{verb|licensed|released|distributed}} under the {{n|2 clause bsd|two clause bsd|simplified bsd|bsd 2 clause}} license"),
    ("bsd-3", "{{verb|licensed|released|distributed}} under the {{n|3 clause bsd|three clause bsd|new bsd|revised bsd|bsd 3 clause}} license"),
    ("cc-by", "{{verb|licensed|released|available}} under [[a]] [[the]] {{name|cc by|creative commons attribution}} [[international]] [[license]] {{v|4 0|3 0|2 0}} [[international]] [[license]]"),
    ("cc-by-sa", "{{name|cc by sa|creative commons attribution sharealike|creative commons attribution share alike}} [[{{v|4 0|3 0|2 0}}]]"),
    ("cc-by-nc", "{{name|cc by nc|creative commons attribution noncommercial|creative commons attribution non commercial}} [[{{v|4 0|3 0|2 0}}]]"),
    ("cc-by-nd", "{{name|cc by nd|creative commons attribution noderivatives|creative commons attribution no derivatives}} [[{{v|4 0|3 0|2 0}}]]"),
    ("cc0", "{{name|cc0|creative commons zero}} [[1 0]] [[universal]] {{kind|license|public domain dedication}}"),
    ("all-rights-reserved", "all rights reserved"),
) + FULL


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_UPPER))


@dataclass
class Automaton:
    """Word automaton of one template; state i is bit i, state 0 the start."""
    label: str
    template: str
    words: dict[str, int] = field(default_factory=dict)      # states entered by a word
    any_word: int = 0                                        # states entered by any word
    follow: list[int] = field(default_factory=lambda: [0])   # states that may come after a state
    final: int = 0                                           # states in which the template is over
    anchor: str = ""                                         # longest run of mandatory words

    def __post_init__(self):
        parts = re.findall(r"\[\[|\]\]|\{\{[^}]*\}\}|" + WORD.pattern, self.template.translate(_UPPER))
        at, ends = self._sequence(parts, 0, {0})
        if at != len(parts):
            raise ValueError(f"unbalanced template: {self.template!r}")
        self.final = sum(1 << s for s in ends)
        if self.final & 1:
            raise ValueError(f"template without mandatory words: {self.template!r}")

    def _step(self, word: str | None, before: set[int]) -> int:
        state = len(self.follow)
        self.follow.append(0)
        for s in before:
            self.follow[s] |= 1 << state
        if word is None:
            self.any_word |= 1 << state
        else:
            self.words[word] = self.words.get(word, 0) | 1 << state
        return state

    def _sequence(self, parts, at, ends, depth=0):
        run: list[str] = []
        while at < len(parts):
            p = parts[at]
            if p == "]]":
                if not depth:
                    raise ValueError(f"unbalanced template: {self.template!r}")
                return at + 1, ends
            if p == "[[":
                run = []
                at, inner = self._sequence(parts, at + 1, ends, depth + 1)
                ends = ends | inner
            elif p.startswith("{{"):
                run, at = [], at + 1
                choices = p[2:-2].split("|")[1:]
                if choices:
                    out = set()
                    for c in choices:
                        e = ends
                        for w in WORD.findall(c):
                            e = {self._step(w, e)}
                        out |= e
                    ends = out
                else:
                    out, e = set(), ends
                    for _ in range(REPLACE):
                        e = {self._step(None, e)}
                        out |= e
                    ends = out
            else:
                ends, at = {self._step(p, ends)}, at + 1
                run.append(p)
                if not depth and len(" ".join(run)) > len(self.anchor):
                    self.anchor = " ".join(run)
        if depth:
            raise ValueError(f"unbalanced template: {self.template!r}")
        return at, ends

    def first_words(self) -> set[str] | None:
        """Words that can begin a match; None for any word."""
        if self.follow[0] & self.any_word:
            return None
        return {w for w, s in self.words.items() if s & self.follow[0]}

    def accept(self, words: list[str], at: int) -> int:
        """End of the longest accepted stretch beginning at ``at``, or -1."""
        state, end = 1, -1
        follow, known, wild = self.follow, self.words, self.any_word
        for i in range(at, len(words)):
            reach, s = 0, state
            while s:
                low = s & -s
                reach |= follow[low.bit_length() - 1]
                s ^= low
            state = reach & (known.get(words[i], 0) | wild)
            if not state:
                break
            if state & self.final:
                end = i + 1
        return end


class Scanner:
    """All base phrases and templates, compiled."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.base = [Automaton(*b) for b in base]
        self.rest = [Automaton(*t) for t in templates]

    def _matches(self, machine: Automaton, joined: str, words: list[str], inside: bool):
        anchor = f" {machine.anchor} "
        found = joined.find(anchor) if machine.anchor else 0
        if found < 0:
            return []
        first, out, at = machine.first_words(), [], 0
        n = len(words)
        while at < n:
            if first is not None and words[at] not in first:
                at += 1
                continue
            end = machine.accept(words, at)
            if end > 0:
                out.append((at, end))
                at = end if inside else at + 1
            else:
                at += 1
        return out

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        joined = f" {' '.join(words)} "
        base = [(a, z, m.label) for m in self.base for a, z in self._matches(m, joined, words, False)]
        more = [(a, z, m.label) for m in self.rest for a, z in self._matches(m, joined, words, True)]
        starts = [a for a, _, _ in base]
        covered, last = 0, 0
        for a, z, _ in sorted(base + more):
            covered += max(0, z - max(a, last))
            last = max(last, z)
        base_labels = sorted({m for _, _, m in base})
        return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None),
                "last_word": max(starts, default=None), "base_labels": ",".join(base_labels),
                "labels": ",".join(sorted({*base_labels, *(m for _, _, m in more)})),
                "score": covered / len(words) if words else 0.0,
                "spans": [{"label": m, "first": a, "end": z} for a, z, m in sorted(more)]}


_SCANNER: Scanner | None = None


def scan(text: str | None) -> dict:
    """:meth:`Scanner.scan` with the built-in templates."""
    global _SCANNER
    if _SCANNER is None:
        _SCANNER = Scanner()
    return _SCANNER.scan(text)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_base, first_word,
    last_word, base_labels, labels, score and spans (label, first word, end)."""
    d = docs.select(id_col, text_col)
    long = F.lit(None).cast("long")          # first_word and last_word may be null
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = F.struct(F.lit("").alias("label"), long.alias("first"), long.alias("end"))
    values = [long, long, long, long, F.lit(""), F.lit(""), F.lit(0.0), F.array(span)]
    schema = d.select(id_col, *[v.alias(n) for v, n in zip(values, names)]).schema
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(),
             pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))]

    def run(batches):
        one = scan if templates is None else Scanner(templates).scan
        for b in sliced(batches, text_col):
            rows = [one(t) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), *[pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)]], names=schema.names)
    return map_text(d, run, schema)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")
