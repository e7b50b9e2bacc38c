"""License scans: matching statistics over a generalised suffix automaton of license tokens.

The automaton holds every run of tokens of every template. A text is streamed through it:
at each word it knows the longest run that ends there and occurs in some template. Maximal
runs are anchors; anchors of one template that follow each other, in the text and in the
template, are chained into spans, and a span that covers enough of its template is a find. Where finds overlap, the
one with most covered words stays, so a license is not taken for one whose notice is part of its own.
The short phrases are templates too: one occurs wherever the current run's state lies at or
below the phrase's own state in the tree of suffix links, so all places are counted.

Words that no template has end every run, so only stretches of two or more known words are walked.

Defined results: a null or empty text has no words, null places, no labels and score 0;
equal texts get equal results; overlapping places all count.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewire.llm import words

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices as published by the licenses' authors (label, text).
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    (
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, "
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "agpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    (
        "lgpl-notice",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
        "License, or (at your option) any later version. This library is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "lgpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    ("mit-notice", "Released under the MIT License"),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in "
        "all copies or substantial portions of the Software.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "epl-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public "
        "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "cc0",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring "
        "rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
        "be held liable for any damages arising from the use of this software. Permission is granted to anyone to "
        "use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions",
    ),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
)

#: Shortest run that is an anchor, widest gap between two anchors of a span, and the part
#: of a template that a find covers.
LEAST_RUN = 3
WIDEST_GAP = 8
LEAST_COVERED = 0.8

SPAN = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("first", T.LongType()),
    T.StructField("last", T.LongType()),
    T.StructField("covered", T.DoubleType()),
])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(SPAN)),
]


class Automaton:
    """The generalised suffix automaton of some token sequences."""

    def __init__(self, sequences: Sequence[Sequence[int]]) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (sequence, last position) of a state's runs
        for number, sequence in enumerate(sequences):
            state = 0
            for position, token in enumerate(sequence):
                state = self._extended(state, token)
                self.ends[state].add((number, position))
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state]

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, above: int, token: int, state: int) -> int:
        """The state for the runs that end like ``state`` and extend ``above`` by ``token``."""
        if self.length[state] == self.length[above] + 1:
            return state
        twin = self._new(self.length[above] + 1, self.link[state], dict(self.next[state]))
        self.link[state] = twin
        while above >= 0 and self.next[above].get(token) == state:
            self.next[above][token] = twin
            above = self.link[above]
        return twin

    def _extended(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token, self.next[last][token])
        state, above = self._new(self.length[last] + 1, 0, {}), last
        while above >= 0 and token not in self.next[above]:
            self.next[above][token] = state
            above = self.link[above]
        if above >= 0:
            self.link[state] = self._split(above, token, self.next[above][token])
        return state

    def step(self, state: int, run: int, token: int) -> tuple[int, int]:
        """State and length of the longest known run after one more token."""
        following = self.next[state]
        if token in following:
            return following[token], run + 1
        while state > 0:
            state = self.link[state]
            if token in self.next[state]:
                return self.next[state][token], self.length[state] + 1
        return (self.next[0][token], 1) if token in self.next[0] else (0, 0)


class Scanner:
    """The automaton of phrases and templates, and what a text's words say against it."""

    def __init__(self, phrases: dict[str, str], templates: Sequence[tuple[str, str]]) -> None:
        texts = [*phrases, *(text for _, text in templates)]
        h, bounds = words.hashes([t.encode() for t in texts], words.ALNUM)
        known = np.unique(h)
        self.tokens = {int(x): i for i, x in enumerate(known)}
        sequences = [[self.tokens[int(x)] for x in h[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]
        self.labels = [*phrases.values(), *(label for label, _ in templates)]
        self.sizes = [len(s) for s in sequences]
        self.phrases = len(phrases)
        self.automaton = Automaton(sequences)
        self.hits = self._phrase_states(sequences)
        # A table by the low bits in which no two known words meet finds known words fast.
        bits = 12
        while len(np.unique(known & np.uint64((1 << bits) - 1))) < len(known):
            bits += 1
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, np.uint64)
        self.table[(known & self.mask).astype(np.int64)] = known

    def _phrase_states(self, sequences: list[list[int]]) -> list[tuple[int, ...]]:
        """For each state the phrases that end where its runs end (as far as those are long enough)."""
        own: dict[int, list[int]] = {}
        for number in range(self.phrases):
            state, run = 0, 0
            for token in sequences[number]:
                state, run = self.automaton.step(state, run, token)
            own.setdefault(state, []).append(number)
        out: list[tuple[int, ...]] = []
        for state in range(len(self.automaton.length)):
            above, found = state, []
            while above > 0:
                found += own.get(above, [])
                above = self.automaton.link[above]
            out.append(tuple(found))
        return out

    def stretches(self, h: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, first word, end) of the stretches of two or more known words."""
        known = np.zeros(len(h) + 2, bool)
        known[1:-1] = self.table[(h & self.mask).astype(np.int64)] == h
        joined = known[1:] & known[:-1]  # joined[i]: words i - 1 and i are both known
        joined[bounds[(bounds > 0) & (bounds < len(h))]] = False  # not over the end of a text
        edges = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]])))
        firsts, ends = edges[0::2] - 1, edges[1::2]
        texts = np.searchsorted(bounds, firsts, side="right") - 1
        return list(zip(texts.tolist(), firsts.tolist(), ends.tolist(), strict=True))

    def walk(self, tokens: list[int], at: int, places: list[tuple[int, int]], anchors: list[tuple[int, int, int]]) -> None:
        """Add phrase places (start, phrase) and anchors (last word, run, state) of a stretch."""
        step, hits, sizes = self.automaton.step, self.hits, self.sizes
        state = run = 0
        for i, token in enumerate(tokens):
            before, length = state, run
            state, run = step(state, run, token)
            if length >= LEAST_RUN and run != length + 1:
                anchors.append((at + i - 1, length, before))
            for number in hits[state]:
                if sizes[number] <= run:
                    places.append((at + i - sizes[number] + 1, number))
        if run >= LEAST_RUN:
            anchors.append((at + len(tokens) - 1, run, state))

    def spans(self, anchors: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Chains of anchors as (template, first word, last word, part covered), best one for each place."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for last, run, state in anchors:
            for number, end in self.automaton.ends[state]:
                if number >= self.phrases:
                    by_template.setdefault(number, []).append((last, end, run))
        found = []
        for number, matches in by_template.items():
            # A chain: covered tokens, first word, last word, last template position.
            chains: list[tuple[int, int, int, int]] = []
            for last, end, run in sorted(matches):
                best = (run, last - run + 1, last, end)
                for covered, first, chain_last, chain_end in reversed(chains):
                    if last - run - chain_last > WIDEST_GAP:
                        break
                    new = min(run, last - chain_last, end - chain_end)
                    if new > 0 and abs((last - end) - (chain_last - chain_end)) <= WIDEST_GAP:
                        best = max(best, (covered + new, first, last, end))
                chains.append(best)
            tops: dict[int, tuple[int, int]] = {}
            for covered, first, last, _ in chains:
                tops[first] = max(tops.get(first, (0, 0)), (covered, last))
            found += [
                (number, first, last, covered / self.sizes[number]) for first, (covered, last) in tops.items()
            ]
        return sorted(found)

    def finds(self, chained: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """The spans that cover enough of their template; of those that overlap, the one with most covered words."""
        enough = [s for s in chained if s[3] >= LEAST_COVERED]
        enough.sort(key=lambda s: (-round(s[3] * self.sizes[s[0]]), -s[3], s))
        firsts: list[int] = []
        taken: list[tuple[int, int, int, float]] = []  # in order of their first words
        for span in enough:
            at = bisect.bisect(firsts, span[2])  # those before begin in this span or ahead of it
            if not at or taken[at - 1][2] < span[1]:
                firsts.insert(at, span[1])
                taken.insert(at, span)
        return sorted(taken)

    def scan(self, texts: list[bytes | None]) -> list[pa.Array]:
        h, bounds = words.hashes(texts, words.ALNUM)
        places: list[list[tuple[int, int]]] = [[] for _ in texts]
        anchors: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for text, first, end in self.stretches(h, bounds):
            tokens = [self.tokens[x] for x in h[first:end].tolist()]
            self.walk(tokens, first - int(bounds[text]), places[text], anchors[text])
        n_base, firsts, lasts, base, labels, scores, spans = [], [], [], [], [], [], []
        for at, runs in zip(places, anchors, strict=True):
            chained = self.spans(runs)
            covered = self.finds(chained)
            own = {self.labels[number] for _, number in at}
            n_base.append(len(at))
            firsts.append(min((start for start, _ in at), default=None))
            lasts.append(max((start for start, _ in at), default=None))
            base.append(",".join(sorted(own)))
            labels.append(",".join(sorted(own | {self.labels[s[0]] for s in covered})))
            scores.append(1.0 if at else min(1.0, max((s[3] for s in chained), default=0.0)))
            spans.append([
                {"label": self.labels[number], "first": first, "last": last, "covered": part}
                for number, first, last, part in covered
            ])
        kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))
        return [
            pa.array(np.diff(bounds), pa.int64()), pa.array(n_base, pa.int64()), pa.array(firsts, pa.int64()),
            pa.array(lasts, pa.int64()), pa.array(base, pa.string()), pa.array(labels, pa.string()),
            pa.array(scores, pa.float64()), pa.array(spans, kind),
        ]


@functools.lru_cache(maxsize=4)
def _scanner(phrases: tuple[tuple[str, str], ...], templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(phrases), templates)


def license_scan(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    phrases: dict[str, str] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """The columns ``keep`` of each document with places, labels, score and covered spans.

    The automaton is made once in each Python worker from the given texts.
    """
    key = tuple(phrases.items()), tuple(templates)
    return words.per_document(docs, keep, lambda texts: _scanner(*key).scan(texts), FIELDS, text)
