"""License scans with a generalised suffix automaton of licence tokens.

All licence templates form one automaton over words. A text is streamed through it once; at each word the
state gives the matching statistic, the longest run of words ending there that stands in some template.
Runs of at least ``ANCHOR`` words (or a whole base phrase) are anchors on the diagonals of the templates they occur in;
anchors that follow each other in text and template with small gaps are chained, and a chain that covers
enough of its template is a span with the template's label.

Words outside every template, and pairs of words that are neighbours in no template, end a match, so only the
stretches between them go through the automaton.

Defined cases: null or empty text has no words, no labels and score 0; a repeated phrase counts at each place;
equal rows give equal results; one very long text is streamed in one task, as one row always is; an empty
table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from shiftlens.llm.common import map_batches, texts

# The base phrases, and notices as the licences publish them.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version"),
    ("gpl-2.0", "GNU General Public License, version 2"),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

ANCHOR = 3  # words of a matching run that begins or extends a chain
GAP = 8  # words between two anchors of one chain, in text and in template
COVERED = 0.8  # share of a template's words that a span covers
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


class Automaton:
    """Suffix automaton of several word sequences; each state knows where its longest word run ends."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (sequence, words up to the run's end)
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence, 1):
                last = self._extend(last, word)
                self.ends[last].add((number, place))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, state: int, word: int) -> int:
        """The target of ``word`` from ``state``, one word longer than ``state``."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word)
        return new

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """(state, length) of the longest run that ends at each word."""
        out, state, length = [], 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            out.append((state, length))
        return out


class Scanner:
    """Templates compiled for scanning; small, made once in each task."""

    def __init__(self, base: dict[str, str] = BASE, templates: list[tuple[str, str]] = TEMPLATES) -> None:
        self.labels = [*base.values(), *(label for label, _ in templates)]
        split = [words_of(x) for x in [*base, *(text for _, text in templates)]]
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for s in split for w in s}))}
        self.sequences = [[self.number[w] for w in s] for s in split]
        self.n_base = len(base)
        self.automaton = Automaton(self.sequences)
        self.neighbours = np.zeros((len(self.number) + 1, len(self.number) + 1), bool)
        for s in self.sequences:
            self.neighbours[s[:-1], s[1:]] = True

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Longest stretches whose neighbouring words are neighbours in some template."""
        linked = self.neighbours[ids[:-1], ids[1:]]
        edge = np.diff(np.concatenate(([0], linked.view(np.int8), [0])))
        return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + 1).tolist(), strict=True))

    def scan(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Base places (start, phrase) and template spans (start, end, template, share covered)."""
        base: list[tuple[int, int]] = []
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        for start, end in self.stretches(ids):
            found = self.automaton.statistics(ids[start:end].tolist())
            for i, (state, length) in enumerate(found):
                at, shorter, here = start + i + 1, state, set()
                while shorter > 0:
                    run = length if shorter == state else self.automaton.length[shorter]
                    for number, place in self.automaton.ends[shorter] if run >= 2 else ():
                        if number < self.n_base and place == len(self.sequences[number]) <= run:
                            here.add((at - place, number))
                    shorter = self.automaton.link[shorter]
                base += here
                grows = i + 1 < len(found) and found[i + 1][1] == length + 1
                if length >= ANCHOR and not grows:
                    for number, place in self.automaton.ends[state]:
                        if number >= self.n_base:
                            anchors.setdefault(number, []).append((at - length, place - length, length))
        return base, [s for number, found in anchors.items() for s in self._chains(number, found)]

    def _chains(self, number: int, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Anchors (text start, template start, length) chained in order; chains that cover enough are spans."""
        size, spans, chain = len(self.sequences[number]), [], []
        for anchor in [*sorted(found), None]:
            if chain and (anchor is None or not self._follows(chain[-1], anchor)):
                covered = len({p for _, b, n in chain for p in range(b, b + n)})
                if covered >= COVERED * size:
                    spans.append((chain[0][0], chain[-1][0] + chain[-1][2], number, covered / size))
                chain = []
            if anchor:
                chain.append(anchor)
        return spans

    @staticmethod
    def _follows(one: tuple[int, int, int], two: tuple[int, int, int]) -> bool:
        return 0 <= two[0] - (one[0] + one[2]) <= GAP and 0 <= two[1] - (one[1] + one[2]) <= GAP


RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<start:long,end:long,label:string,covered:double>>"
)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base phrase places, labels and covered template spans of every row of ``docs``. One pass, no shuffle.

    ``score`` is the largest share of a template covered, 1 where a base phrase stands.
    """

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                ids = np.fromiter(map(scanner.number.get, words, [0] * len(words)), np.int32, len(words))
                base, spans = scanner.scan(ids) if len(words) > 1 else ([], [])
                places, names = [at for at, _ in base], {scanner.labels[k] for _, k in base}
                every = names | {scanner.labels[k] for _, _, k, _ in spans}
                score = 1.0 if base else max([s[3] for s in spans], default=0.0)
                row = (doc, len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(names)), ",".join(sorted(every)), score)
                marked = [{"start": a, "end": b, "label": scanner.labels[k], "covered": c} for a, b, k, c in sorted(spans)]
                for column, value in zip(out, (*row, marked), strict=True):
                    column.append(value)
            yield out

    return map_batches(texts(docs, id_col, text_col), run, RESULT)
