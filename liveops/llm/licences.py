"""Licence texts in documents by matching statistics on a generalised suffix automaton.

The automaton holds all template texts and phrases as sequences of words. Words of a document
run through it: each place gets the length of the longest stretch of words ending there that
stands in any template. Stretches of ``LEAST`` words or more that cannot be extended are chained
along each template, in order and with gaps of up to ``GAP`` words, into spans; a span that
covers at least ``SHARE`` of its template's words carries the template's label. Phrases are
counted where their words stand, through the automaton's suffix links.

Only runs of words that occur in some template are walked; any other word ends every match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from liveops.llm.words import ALNUM, chunks, split

LEAST, GAP, SHARE = 4, 8, 0.5

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices and openings of public licences, as (label, text).
TEMPLATES = (
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("mit-notice", "Released under the MIT License."),
    ("mit-text", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software."
    )),
    ("apache-2.0-text", (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    )),
    ("gpl-text", (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    )),
    ("bsd-text", (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer."
    )),
    ("cc-by-text", (
        "This work is licensed under a Creative Commons Attribution 4.0 International License."
    )),
    ("all-rights-reserved", "All rights reserved."),
)


@dataclass
class Automaton:
    """States of a generalised suffix automaton over numbered words (from 1)."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def _state(self, length: int, next_: dict[int, int], link: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: int) -> int:
        """The state of p's longest string and ``word``, parted from longer ones if need be."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._split(last, word)
                continue
            new = self._state(self.length[last] + 1, {}, 0)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            self.link[new] = self._split(p, word) if p >= 0 else 0
            last = new

    def walk(self, words: list[int]) -> tuple[list[int], list[int]]:
        """State and matched length after each word."""
        next_, link, length = self.next, self.link, self.length
        state, matched = 0, 0
        states, lengths = [], []
        for word in words:
            while state and word not in next_[state]:
                state = link[state]
                matched = length[state]
            if word in next_[state]:
                state = next_[state][word]
                matched += 1
            states.append(state)
            lengths.append(matched)
        return states, lengths


class Scanner:
    """Templates and phrases compiled for reading documents."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.templates = []
        for label, text in templates:
            self.templates.append((label, self._words(text)))
        self.phrases = [(tuple(self._words(p)), label) for p, label in phrases.items()]
        every = [w for _, w in self.templates] + [list(p) for p, _ in self.phrases]
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for ws in every for w in ws), 1)}
        self.coded = [[self.number[w] for w in ws] for ws in every]
        self.automaton = Automaton()
        for words in self.coded:
            self.automaton.add(words)
        # Phrases that end at a state: (words, phrase) of it and of its suffix links.
        ends: list[list[tuple[int, int]]] = [[] for _ in self.automaton.next]
        for k, (words, _) in enumerate(self.phrases):
            state = 0
            for w in words:
                state = self.automaton.next[state][self.number[w]]
            ends[state].append((len(words), k))
        order = sorted(range(len(ends)), key=self.automaton.length.__getitem__)
        self.ends = [tuple(e) for e in ends]
        for s in order[1:]:
            self.ends[s] = (*ends[s], *self.ends[self.automaton.link[s]])
        # Where each stretch of ``LEAST`` words stands in the templates.
        self.places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for t in range(len(self.templates)):
            words = self.coded[t]
            size = min(LEAST, len(words))
            for i in range(len(words) - size + 1):
                self.places.setdefault(tuple(words[i : i + size]), []).append((t, i))
        self.sizes = sorted({min(LEAST, len(w)) for w in self.coded[: len(self.templates)]})

    @staticmethod
    def _words(text: str) -> list[str]:
        found = split(pa.array([text]), ALNUM)
        return found.words.take(pa.array(found.codes)).to_pylist()

    def _anchors(self, words: list[int], lengths: list[int]) -> list[tuple[int, int, int]]:
        """(template, place in it, place in the run) of every stretch that matches for long enough."""
        out = []
        for size in self.sizes:
            for end, matched in enumerate(lengths):
                if matched >= size:
                    start = end - size + 1
                    for t, i in self.places.get(tuple(words[start : end + 1]), ()):
                        if min(LEAST, len(self.coded[t])) == size:
                            out.append((t, i, start, size))
        return out

    def chain(self, anchors) -> list[tuple[int, int, int, int]]:
        """(template, first word, last word, covered) of spans that cover enough of a template."""
        spans = []
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for t, i, start, size in anchors:
            by_template.setdefault(t, []).append((start, i, size))
        for t, mine in by_template.items():
            whole = len(self.coded[t])
            # Open chains by the place in the template they wait for; each anchor extends the one
            # that reaches furthest before it.
            chains: list[list[int]] = []  # first, last word, last place, covered
            for start, i, size in sorted(mine):
                best = None
                for c in chains:
                    ahead = i + size - 1 - c[2]
                    if ahead > 0 and start + size - 1 > c[1] and start - c[1] <= GAP and i - c[2] <= GAP:
                        gain = min(ahead, size, start + size - 1 - c[1])
                        if best is None or c[3] + gain > best[0]:
                            best = (c[3] + gain, c)
                if best is None:
                    chains.append([start, start + size - 1, i + size - 1, size])
                else:
                    covered, c = best
                    c[1], c[2], c[3] = start + size - 1, i + size - 1, covered
                done = [c for c in chains if start - c[1] > GAP]
                spans += [(t, c[0], c[1], c[3]) for c in done if c[3] >= SHARE * whole]
                chains = [c for c in chains if start - c[1] <= GAP]
            spans += [(t, c[0], c[1], c[3]) for c in chains if c[3] >= SHARE * whole]
        return spans

    def read(self, codes: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Phrases as (start, phrase) and spans of one document, given its words' numbers (0: none)."""
        hits: list[tuple[int, int]] = []
        anchors: list[tuple[int, int, int, int]] = []
        inside = np.flatnonzero(codes)
        if not len(inside):
            return hits, []
        edges = np.flatnonzero(np.diff(inside) > 1)
        starts, ends = np.append(inside[0], inside[edges + 1]), np.append(inside[edges], inside[-1]) + 1
        for a, b in zip(starts, ends, strict=True):
            if b - a < self.shortest:
                continue
            words = codes[a:b].tolist()
            states, lengths = self.automaton.walk(words)
            if max(lengths) < self.shortest:
                continue
            for end, (state, matched) in enumerate(zip(states, lengths, strict=True)):
                for size, k in self.ends[state]:
                    if matched >= size:
                        hits.append((int(a) + end - size + 1, k))
            anchors += [(t, i, int(a) + s, n) for t, i, s, n in self._anchors(words, lengths)]
        return hits, self.chain(anchors)

    @property
    def shortest(self) -> int:
        return min([len(p) for p, _ in self.phrases] + self.sizes)


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Phrases and licence spans of every row of ``docs`` (doc_id, text), one row each.

    Returns doc_id, n_words, phrase_starts (array of word numbers, rising), phrase_labels (of these
    places), spans (array of label, first, last, covered, template_words). Null and empty texts
    have no words. Rows that repeat are each read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        span_type = pa.struct([
            ("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()),
            ("covered", pa.int64()), ("template_words", pa.int64()),
        ])
        for batch in chunks(batches):
            words = split(batch.column("text"), ALNUM)
            known = pc.index_in(words.words, pa.array(list(scanner.number)))
            numbers = pc.fill_null(pc.add(known, 1), 0).to_numpy(False)
            codes = numbers[words.codes] if len(words.codes) else np.zeros(0, np.int64)
            starts, labels, spans = [], [], []
            for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True):
                hits, found = scanner.read(codes[a:b])
                hits.sort()
                starts.append([h[0] for h in hits])
                labels.append([scanner.phrases[h[1]][1] for h in hits])
                spans.append([
                    {
                        "label": scanner.templates[t][0], "first": first, "last": last,
                        "covered": covered, "template_words": len(scanner.coded[t]),
                    }
                    for t, first, last, covered in sorted(found, key=lambda s: (s[1], s[0]))
                ])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(words.counts), pa.array(starts, pa.list_(pa.int64())),
                    pa.array(labels, pa.list_(pa.string())), pa.array(spans, pa.list_(span_type)),
                ],
                names=["doc_id", "n_words", "phrase_starts", "phrase_labels", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run,
        "doc_id long, n_words long, phrase_starts array<long>, phrase_labels array<string>, spans "
        "array<struct<label:string,first:long,last:long,covered:long,template_words:long>>",
    )
