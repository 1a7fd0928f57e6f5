"""License scans by template-markup matching with token automata.

A template is written in the public markup for license texts: plain words are
mandatory, ``<<beginOptional>>...<<endOptional>>`` may be absent, and
``<<var;name=...;original=...;match=min-max>>`` stands for any min to max words.
Each template is compiled to a nondeterministic automaton over tokens (one state a
position, empty moves over optional regions and finished variables) and run over
the words of whole texts. A template matches where all mandatory wording is met
word for word; its label is then added to the labels of the base phrases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ASCII-only word characters and all others; texts are lower-cased A-Z first.
WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and the labels they stand for.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Wording of widespread public licenses and their notices, as templates; a
# label may have several. Disclaimers that all copies of a license share are optional.
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: <<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. <<beginOptional>>2. <<endOptional>>Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution. """
_DISCLAIMER = "<<beginOptional>>THIS SOFTWARE IS PROVIDED BY <<var;name=holder;original=the copyright holders;match=1-12>> AS IS <<endOptional>>"
TEMPLATES = {
    "apache-2.0": (
        "licensed under the apache license <<beginOptional>>, <<endOptional>>version 2.0",
        """Apache License Version 2.0, January 2004 <<beginOptional>>http://www.apache.org/licenses/ <<endOptional>>TERMS AND CONDITIONS
        FOR USE, REPRODUCTION, AND DISTRIBUTION""",
    ),
    "cc-by-nc-4.0": "licensed under <<beginOptional>>a creative commons <<endOptional>>cc by-nc 4.0",
    "cc-by-4.0": "licensed under <<beginOptional>>a creative commons <<endOptional>>cc by 4.0",
    "cc-by-sa-4.0": "licensed under <<beginOptional>>a creative commons <<endOptional>>cc by-sa 4.0",
    "gpl-3.0": "gnu general public license <<beginOptional>>as published by the free software foundation <<endOptional>><<beginOptional>>either <<endOptional>>version 3",
    "gpl-2.0": "gnu general public license <<beginOptional>>as published by the free software foundation <<endOptional>><<beginOptional>>either <<endOptional>>version 2",
    "lgpl-3.0": "gnu lesser general public license <<beginOptional>>as published by the free software foundation <<endOptional>><<beginOptional>>either <<endOptional>>version 3",
    "agpl-3.0": "gnu affero general public license <<beginOptional>>as published by the free software foundation <<endOptional>><<beginOptional>>either <<endOptional>>version 3",
    "mpl-2.0": "subject to the terms of the mozilla public license <<beginOptional>>, <<endOptional>><<beginOptional>>v. <<endOptional>><<beginOptional>>version <<endOptional>>2.0",
    "isc": """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies""",
    "mit": (
        "<<var;name=verb;original=released;match=1-1>> under the mit license",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: <<beginOptional>>The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial portions of the
        Software.<<endOptional>>""",
    ),
    "copyright-notice": "copyright <<beginOptional>>c <<endOptional>><<var;name=holder;original=2020 the authors;match=1-12>> all rights reserved",
    "bsd-2-clause": _BSD_CONDITIONS + "THIS SOFTWARE IS PROVIDED BY <<var;name=holder;original=the copyright holders;match=1-12>> AS IS",
    "bsd-3-clause": _BSD_CONDITIONS
    + """<<beginOptional>>3. <<endOptional>>Neither the name of <<var;name=holder;original=the copyright holder;match=1-12>> nor the names of
        <<var;name=whose;original=its;match=1-3>> contributors may be used to endorse or promote products derived from this software without
        specific prior written permission """
    + _DISCLAIMER,
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
}

_TOKEN = re.compile(WORD_RE)
_MARKUP = re.compile(r"<<(.*?)>>", re.S)


def fold(text: str | None) -> str:
    """A-Z lower-cased, nothing else; null is empty."""
    return "" if text is None else text.translate(_FOLD)


_FOLD = {c: c + 32 for c in range(65, 91)}


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(fold(text))


class State(NamedTuple):
    word: str | None  # None: any word
    skips: tuple[int, ...]  # states reachable without reading


class Automaton:
    """States 0 to n - 1 each read one word and go on to the next; n accepts."""

    def __init__(self, template: str) -> None:
        words: list[str | None] = []
        skips: dict[int, list[int]] = {}
        opened: list[int] = []
        at = 0
        for m in [*_MARKUP.finditer(template), None]:
            words += tokens(template[at : m.start() if m else len(template)])
            if m is None:
                break
            at = m.end()
            kind, *fields = m[1].split(";")
            if kind == "beginOptional":
                opened.append(len(words))
            elif kind == "endOptional":
                if not opened:
                    raise ValueError("endOptional without beginOptional")
                skips.setdefault(opened.pop(), []).append(len(words))
            elif kind == "var":
                low, high = map(int, dict(f.split("=", 1) for f in fields)["match"].split("-"))
                if not 0 <= low <= high:
                    raise ValueError(f"bad range in {m[0]}")
                end = len(words) + high
                for k in range(low, high):
                    skips.setdefault(len(words) + k, []).append(end)
                words += [None] * high
            else:
                raise ValueError(f"unknown markup {m[0]}")
        if opened:
            raise ValueError("beginOptional without endOptional")
        self.states = [State(w, tuple(skips.get(k, ()))) for k, w in enumerate(words)]
        self.accept = len(words)
        if self.accept in self.closure({0}):
            raise ValueError("a template needs mandatory wording")

    def closure(self, now: set[int]) -> set[int]:
        todo = list(now)
        now = set(now)
        while todo:
            k = todo.pop()
            if k < self.accept:
                for to in self.states[k].skips:
                    if to not in now:
                        now.add(to)
                        todo.append(to)
        return now

    @cached_property
    def anchor(self) -> tuple[str, int, int]:
        """(a mandatory word, the fewest and most words before it): where to look. Words with
        few possible distances to the start come first, then long words."""
        mandatory = [k for k, s in enumerate(self.states) if s.word is not None and not any(j <= k < to for j, t in enumerate(self.states) for to in t.skips)]
        if not mandatory:
            raise ValueError("a template needs mandatory wording")
        may_miss = [any(i <= j < to for i, t in enumerate(self.states) for to in t.skips) for j in range(self.accept)]
        k = max(mandatory, key=lambda k: (-sum(may_miss[:k]), len(self.states[k].word)))
        return self.states[k].word, k - sum(may_miss[:k]), k

    def run(self, words: list[str], start: int) -> int | None:
        """End of the shortest match that begins at word ``start``, or None."""
        now = self.closure({0})
        for at in range(start, len(words)):
            w = words[at]
            now = self.closure({k + 1 for k in now if k < self.accept and self.states[k].word in (None, w)})
            if self.accept in now:
                return at + 1
            if not now:
                return None
        return None

    def find(self, words: list[str], places: list[int]) -> tuple[int, int] | None:
        """First match among starts that put the anchor word at one of ``places``."""
        _, fewest, most = self.anchor
        tried: set[int] = set()
        for p in places:
            for start in range(max(0, p - most), p - fewest + 1):
                if start not in tried:
                    tried.add(start)
                    if (end := self.run(words, start)) is not None:
                        return start, end
        return None


def each_template(templates: dict[str, str | tuple[str, ...]]) -> Iterator[tuple[str, str]]:
    """(label, template), for labels with one or several templates."""
    for label, t in templates.items():
        for one in (t,) if isinstance(t, str) else t:
            yield label, one


class Scanner:
    def __init__(self, templates: dict[str, str | tuple[str, ...]], phrases: dict[str, str]) -> None:
        self.automata = [(label, Automaton(t)) for label, t in each_template(templates)]
        self.phrases = [(p.split(" "), label) for p, label in phrases.items()]
        self.wanted = {a.anchor[0] for _, a in self.automata} | {p[0] for p, _ in self.phrases}
        self.gate = re.compile("|".join(sorted(map(re.escape, self.wanted))))

    def scan(self, text: str | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base labels, labels, spans of templates)."""
        text = fold(text)
        words = _TOKEN.findall(text)
        starts, base, spans = [], set(), []
        if self.gate.search(text):
            places: dict[str, list[int]] = {}
            for k, w in enumerate(words):
                if w in self.wanted:
                    places.setdefault(w, []).append(k)
            for phrase, label in self.phrases:
                found = [k for k in places.get(phrase[0], ()) if words[k : k + len(phrase)] == phrase]
                starts += found
                if found:
                    base.add(label)
            for label, automaton in self.automata:
                if (at := places.get(automaton.anchor[0])) and (span := automaton.find(words, at)):
                    spans.append((label, *span))
        labels = base | {s[0] for s in spans}
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(base), sorted(labels), spans


def scan_licenses(df: DataFrame, templates: dict[str, str | tuple[str, ...]] = TEMPLATES, phrases: dict[str, str] = BASE_PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, spans``.

    ``spans`` lists, for each matching template, its label and the first match's
    word range. ``score`` is 1 - 2**-(number of distinct labels). A null or empty
    text has no words, no labels (empty strings) and score 0. Null and repeated ids
    are scanned like any other row; extra columns are ignored; an empty table gives
    an empty result. Scanning needs no shuffle.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        schema = pa.schema(
            [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
            + [("spans", pa.list_(pa.struct([("label", pa.string()), ("from_word", pa.int64()), ("to_word", pa.int64())])))]
        )
        for b in batches:
            rows = []
            for text in b.column(1):
                n, n_base, first, last, base, labels, spans = scanner.scan(text.as_py())
                spans = [dict(zip(("label", "from_word", "to_word"), s, strict=True)) for s in spans]
                rows.append((n, n_base, first, last, ",".join(base), ",".join(labels), 1 - 0.5 ** len(labels), spans))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", *schema.names])

    out = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,from_word:long,to_word:long>>"
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, f"doc_id {kind}, {out}")
