"""Licence scan with a generalised suffix automaton over licence tokens.

The automaton holds every run of words of every template.  Streaming a text through it gives,
after each word, the longest run ending there that some template contains (the matching
statistics).  Long maximal matches are chained per template in text order, and a template whose
words the chain covers well gives its label.  Three fixed phrases give labels wherever they stand.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.common import query, read, small_batches

# Phrase, label.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Label and wording of licence notices as their publishers give them.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software.""",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "mpl-2",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    ("all-rights-reserved", "All rights reserved."),
]

# Bytes that separate words: ASCII but for digits and letters.  Letters become lower case.
_SEPARATE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

MIN_MATCH = 3
MIN_COVERED = 0.8
# A chain goes on over so many foreign words, or this many times the template's own, if that is more.
LEAST_GAP, GAP_TIMES = 200, 4


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_SEPARATE).split()


class Automaton:
    """Suffix automaton of several word sequences; words are numbered, unknown words have no number."""

    def __init__(self, sequences: list[list[bytes]]):
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        # For each state: sequence number -> positions of the last words of all its occurrences, in order.
        self.ends: list[dict[int, list[int]]] = [{}]
        for s, words in enumerate(sequences):
            last = 0
            for place, word in enumerate(words):
                last = self._extend(last, self.number.setdefault(word, len(self.number)))
                self.ends[last].setdefault(s, []).append(place)
        for state in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            above = self.ends[self.link[state]] if self.link[state] > 0 else None
            if above is not None:
                for s, places in self.ends[state].items():
                    above.setdefault(s, []).extend(places)
        for found in self.ends:
            for places in found.values():
                places.sort()

    def _add(self, length: int, transitions: dict[int, int], link: int) -> int:
        self.next.append(transitions)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, parent: int, word: int, child: int) -> int:
        twin = self._add(self.length[parent] + 1, dict(self.next[child]), self.link[child])
        self.link[child] = twin
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = twin
            parent = self.link[parent]
        return twin

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        state = self._add(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last >= 0:
            child = self.next[last][word]
            self.link[state] = child if self.length[child] == self.length[last] + 1 else self._split(last, word, child)
        return state

    def state_of(self, words: list[bytes]) -> int:
        state = 0
        for word in words:
            state = self.next[state][self.number[word]]
        return state

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(place, length, state) after each word that ends a match; other places are skipped."""
        number, following, link, longest = self.number.get, self.next, self.link, self.length
        state = length = 0
        for place, word in enumerate(words):
            n = number(word)
            if n is None:
                state = length = 0
                continue
            while state and n not in following[state]:
                state = link[state]
                length = longest[state]
            state = following[state].get(n, 0)
            if state:
                length += 1
                yield place, length, state
            else:
                length = 0


def chain(matches: list[tuple[int, int, list[int]]], size: int) -> list[tuple[int, int, float]]:
    """Covered spans of one template: (first word, last word, share of the template's words covered).

    ``matches`` are (last place in the text, length, last places in the template), in text order by end and by beginning.  Chains go forward in text and
    template, over no more foreign words than ``LEAST_GAP`` or ``GAP_TIMES`` the template's; what overlaps counts
    once.  Chains are laid one after the other so that they cover most words, where each costs one word less than the
    shortest match, so none is cut without need.  The search keeps the best chain so far per place in the template only, so
    matches that overlap in odd ways may end up in chains a few words short of the best.
    """
    gap, cost = max(LEAST_GAP, GAP_TIMES * size), min(MIN_MATCH, size) - 1
    # A node is (words gained, last word in the text, chain it belongs to: first word and words covered, node before the chain).
    best: dict[int, tuple] = {}
    top: tuple = (0, -1, None, 0, None)
    last = top
    waiting: deque[tuple[int, tuple]] = deque()
    for place, length, places in matches:
        first = place - length + 1
        while waiting and waiting[0][0] < first:
            node = waiting.popleft()[1]
            if node[0] > top[0]:
                top = node
        made = []
        for at in places:
            chosen = (top[0] + length - cost, place, first, length, top)
            for before, node in best.items():
                if before < at and node[1] < place and first - 1 - node[1] <= gap:
                    more = min(length, at - before, place - node[1])
                    if node[0] + more >= chosen[0]:
                        chosen = (node[0] + more, place, node[2], node[3] + more, node[4])
            made.append((at, chosen))
        for at, node in made:
            known = best.get(at)
            if known is None or node[0] >= known[0] or first - 1 - known[1] > gap:
                best[at] = node
        heaviest = max((node for _, node in made), key=lambda n: n[0])
        waiting.append((place, heaviest))
        last = max(last, heaviest, key=lambda n: n[0])
    spans = []
    while last[4] is not None:
        if last[0] > last[4][0]:
            spans.append((last[2], last[1], last[3] / size))
        last = last[4]
    return spans[::-1]


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES):
        self.labels = [label for label, _ in templates]
        tokens = [words_of(text) for _, text in templates]
        fixed = [words_of(phrase) for phrase, _ in phrases]
        self.sizes = [len(t) for t in tokens]
        self.automaton = Automaton([*tokens, *fixed])
        # State of each phrase: the phrase ends wherever the current match has it as a suffix.
        self.phrases = {self.automaton.state_of(words): (len(words), label) for words, (_, label) in zip(fixed, phrases, strict=True)}
        self.found_at: list[tuple[tuple[int, str, int], ...]] = []
        for state in range(len(self.automaton.next)):
            found, above = [], state
            while above > 0:
                if above in self.phrases:
                    found.append((*self.phrases[above], above))
                above = self.automaton.link[above]
            self.found_at.append(tuple(found))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """Places (start, label) of the phrases, and covered spans (label, first word, last word, share)."""
        places: list[tuple[int, str]] = []
        per_template: dict[int, list[tuple[int, int, list[int]]]] = {}
        ends, found_at = self.automaton.ends, self.found_at
        open_match: tuple[int, int, int] | None = None

        def close(match: tuple[int, int, int]) -> None:
            place, length, state = match
            for s, at in ends[state].items():
                if s < len(self.sizes) and length >= min(MIN_MATCH, self.sizes[s]):
                    per_template.setdefault(s, []).append((place, length, at))

        for place, length, state in self.automaton.statistics(words):
            for size, label, _ in found_at[state]:
                if length >= size:
                    places.append((place - size + 1, label))
            if open_match is not None and (place != open_match[0] + 1 or length != open_match[1] + 1):
                if open_match[1] >= MIN_MATCH:
                    close(open_match)
            open_match = (place, length, state)
        if open_match is not None and open_match[1] >= MIN_MATCH:
            close(open_match)
        spans = [(self.labels[s], *span) for s, found in per_template.items() for span in chain(found, self.sizes[s])]
        return sorted(places), sorted(spans)


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.StringType()),
    ]
)


def _report(scanner: Scanner, text: str | None) -> tuple:
    words = words_of(text)
    places, spans = scanner.scan(words)
    good = [s for s in spans if s[3] >= MIN_COVERED]
    base = sorted({label for _, label in places})
    labels = sorted({*base, *(s[0] for s in good)})
    score = 1.0 if base else max([0.0, *(min(1.0, s[3]) for s in spans)])
    starts = [start for start, _ in places]
    told = ";".join(f"{label}:{first}-{last}" for label, first, last, _ in good)
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(places), first, last, ",".join(base), ",".join(labels), score, told


def scan_column(templates: list[tuple[str, str]] = TEMPLATES):
    @F.pandas_udf(FOUND)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates)
        for texts in batches:
            found = pd.DataFrame([_report(scanner, t) for t in texts], columns=FOUND.names)
            yield found.astype({"first_word": "Int64", "last_word": "Int64"})

    return scan


def scan_licences(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """All columns of ``docs`` but the text, and what the scan found in it.

    ``n_words``, ``n_base`` (places of the fixed phrases), ``first_word`` and ``last_word`` (their
    smallest and largest start, else NULL), ``base_labels`` and ``labels`` (comma-joined, empty if
    none), ``score`` (1 with a phrase, else the best covered share of a template) and ``spans``
    (``label:first-last`` of well covered templates).  These replace columns of the same names.
    NULL is an empty text.  Every row is scanned alone and whole; none is dropped.  Rows given twice and NULL ids are
    judged alike, an empty table gives no rows, and a text of any length takes time in proportion to it.  ``TEMPLATES``
    are the publishers' short notices and the first paragraphs of the long ones; give others as (label, text).
    """
    kept = [c for c in docs.columns if c != text and c not in FOUND.names]
    return docs.select(*[docs[c] for c in kept], scan_column(templates)(docs[text]).alias("_found")).select(*kept, "_found.*")


@query("op10_licences")
def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return scan_licences(read(spark, sf_dir, "documents").select("doc_id", "text"))
