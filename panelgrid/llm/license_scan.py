"""License scans by template-markup matching.

A template is text with markup: ``[[...]]`` is optional wording, ``<<k>>`` stands for up to k words of
any kind, the rest is mandatory. It is compiled to a small automaton over words, and a text has the
template's label where the automaton accepts a run of its words, so mandatory wording matches word
by word. Phrases are templates without markup.

Templates are whole public texts and notices, beginnings of such, and names. The score tells how much
wording was accepted: n / (n + 1) for the longest accepted run of n words, so a name alone stays below a
notice, and that below a whole text.

Words: after lower-casing A-Z, maximal runs of characters other than ASCII ones that aren't letters
or digits. Null counts as empty text, which has no words. Rows are kept one by one, repeated or not; other columns may
have any names; an empty table gives no rows. Templates that accept at one place each have their place, in the order of
the templates. Texts are read whole: a walk from a word ends with the first word that no template goes on with, so
no walk is longer than its template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEXTS

#: The phrases to be found, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Templates of longer wording: whole texts, beginnings of them, and names. Label, template.
TEMPLATES = (
    *TEXTS,
    ("apache-2.0", "licensed under the apache license [[,]] version 2 [[0]]"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the [[terms of the]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this <<6>> and associated documentation files"),
    ("gpl-3.0", "licensed under the gnu general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("gpl-2.0", "licensed under the gnu general public license [[as published by the free software foundation]] [[either]] version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "mozilla public license [[v]] [[version]] 2 0"),
    ("cc-by-nc", "licensed under [[a]] [[the]] cc by nc"),
    ("cc-by-sa", "licensed under [[a]] [[the]] cc by sa"),
    ("cc-by", "licensed under [[a]] [[the]] cc by [[4]] [[3]] 0"),
    ("cc0", "licensed under [[the]] cc0"),
    ("proprietary", "all rights reserved [[<<3>>]] no part of this <<3>> may be reproduced"),
)

#: ASCII other than letters and digits to spaces, A-Z to a-z.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() and not chr(c).isupper() else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    # NUL and the other control characters are separators too; lone surrogates can't occur in a Spark string
    return text.encode().translate(_TABLE).split() if text else []


class Automaton:
    """Templates compiled into one automaton. A state is (template, position); a token is a word,
    an optional run of tokens, or a number of arbitrary words."""

    def __init__(self, templates: Sequence[tuple[str, str]]):
        self.labels = [label for label, _ in templates]
        #: position -> (word or None for any, next position), and skips without a word
        self.steps: list[list[tuple[bytes | None, int]]] = []
        self.skips: list[list[int]] = []
        self.accepts: dict[int, int] = {}
        self.first: dict[bytes, list[int]] = {}
        for k, (_, template) in enumerate(templates):
            start = self._state()
            end = self._compile(re.findall(r"\[\[|\]\]|<<\d+>>|[^\s\[\]<>]+", template), start)
            self.accepts[end] = k
            for s in self._closure({start}):
                if s in self.accepts:
                    raise ValueError(f"template without mandatory wording: {template}")
                for word, _ in self.steps[s]:
                    if word is None:
                        raise ValueError(f"template that begins with arbitrary words: {template}")
                    if start not in self.first.setdefault(word, []):
                        self.first[word].append(start)

    def _state(self) -> int:
        self.steps.append([])
        self.skips.append([])
        return len(self.steps) - 1

    def _compile(self, tokens: list[str], at: int) -> int:
        opened = []
        for token in tokens:
            if token == "[[":
                opened.append(at)
            elif token == "]]":
                self.skips[opened.pop()].append(at)
            elif token.startswith("<<"):
                for _ in range(int(token[2:-2])):
                    to = self._state()
                    self.steps[at].append((None, to))
                    self.skips[at].append(to)
                    at = to
            else:
                for word in words_of(token):
                    to = self._state()
                    self.steps[at].append((word, to))
                    at = to
        if opened:
            raise ValueError("[[ without ]]")
        return at

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def run(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(first word, end, label) of the shortest acceptance of each template from each place."""
        found = []
        for i, w in enumerate(words):
            for start in self.first.get(w, ()):
                states, j = self._closure({start}), i
                while states and not (hit := states & self.accepts.keys()) and j < len(words):
                    states = self._closure({to for s in states for word, to in self.steps[s] if word is None or word == words[j]})
                    j += 1
                if states and hit:
                    found.append((i, j, self.labels[self.accepts[min(hit)]]))
        return found

    def required(self) -> frozenset[bytes]:
        """Words of which every accepted text has one: the first mandatory ones."""
        return frozenset(self.first)


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Returns per row id_col, n_words, places array<struct<start, end, label, base>> (words from 0,
    end exclusive; base: of a phrase), score: n / (n + 1) for the longest place's n words, 0 without one."""
    exact, wider = Automaton([(label, text) for text, label in phrases]), Automaton(list(templates))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        place = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("base", pa.bool_())])
        for b in batches:
            counts, places, scores = [], [], []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                seen = set(words)
                base = exact.run(words) if not exact.first.keys().isdisjoint(seen) else []
                more = wider.run(words) if not wider.first.keys().isdisjoint(seen) else []
                counts.append(len(words))
                places.append([{"start": s, "end": e, "label": x, "base": k} for k, found in ((True, base), (False, more)) for s, e, x in found])
                longest = max((e - s for s, e, _ in (*base, *more)), default=0)
                scores.append(longest / (longest + 1))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(counts, pa.int64()), pa.array(places, pa.list_(place)), pa.array(scores, pa.float64())], names=["id", "n_words", "places", "score"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, places array<struct<start bigint, end bigint, label string, base boolean>>, score double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
