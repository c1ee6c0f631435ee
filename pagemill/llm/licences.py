"""Licence scan: a generalised suffix automaton of licence templates gives the matching statistics of every text, and
long matches are chained into covered spans of a template.

Templates are whole licences, the clauses of short ones and usual notices, about 20,000 words; every task builds
its automata from them.
Texts are streamed through it word by word; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from pagemill.llm.common import slices
from pagemill.llm.licence_texts import SHORT, clause_texts, whole_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LEAST_MATCH = 4  # words of a match that can be chained
MOST_GAP = 12  # words of the text, and of the template, between chained matches of a notice or clause
REMARK = 40  # words of the text between chained matches of a whole licence; of the licence any number may be missing
SHORT_NOTICE = 12  # words; a notice up to here says little more than the name, so all of it must stand there
COVERED = 0.75  # share of a longer notice or clause that a chain must cover for its label
COVERED_WHOLE = 0.5  # the same for a whole licence

# Phrases whose places are counted, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Usual notices and openings of licences, by label.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction",
        "licensed under the MIT license",
        "released under the MIT license",
    ),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
        "licensed under the Apache License, Version 2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "licensed under the BSD license",
    ),
    "gpl-3": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License",
        "licensed under the GNU General Public License, version 3",
    ),
    "gpl-2": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License",
        "licensed under the GNU General Public License, version 2",
    ),
    "mpl-2": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted",
    ),
    "cc-by-nc": (
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "licensed under CC BY-NC 4.0",
    ),
    "cc-by-sa": (
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "licensed under CC BY-SA 4.0",
    ),
    "cc-by": (
        "licensed under a Creative Commons Attribution 4.0 International License",
        "licensed under CC BY 4.0",
    ),
    "lgpl-3": ("licensed under the GNU Lesser General Public License, version 3",),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License",
        "licensed under the GNU Lesser General Public License, version 2.1",
    ),
    "agpl-3": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License",
        "licensed under the GNU Affero General Public License, version 3",
    ),
    "epl-2": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at",
        "licensed under the Eclipse Public License, version 2.0",
    ),
    "cc0": ("dedicated to the public domain under CC0 1.0 Universal",),
    "all-rights-reserved": ("All rights reserved. No part of this publication may be reproduced",),
}

CLAUSES, WHOLE = clause_texts(), whole_texts()


def worded(notice: str) -> list[str]:
    """A notice and, where it is short and says ``under``, the same behind any verb and with ``the terms of``."""
    head, under, name = notice.partition("under ")
    if not under or len(words(notice)) > SHORT_NOTICE:
        return [notice]
    return [notice, f"under {name}", f"under the terms of {name}"]


def words(text: str) -> list[str]:
    """Words of a text with A to Z lower-cased: digits, letters and everything outside of ASCII."""
    return WORD.findall(text.translate(LOWER))


@dataclass
class Automaton:
    """Generalised suffix automaton of several word sequences.

    State 0 is the root. ``whole`` holds, for every state, the sequences that end there or at one of its suffixes, with
    their lengths.
    """

    sequences: list[list[str]]
    step: list[dict[str, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    whole: list[list[tuple[int, int]]] = field(default_factory=list)

    def __post_init__(self):
        ends = []
        for sequence in self.sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
            ends.append(last)
        own: dict[int, list[tuple[int, int]]] = {}
        for number, state in enumerate(ends):
            own.setdefault(state, []).append((number, len(self.sequences[number])))
        self.whole = [[] for _ in self.step]
        for state in sorted(range(len(self.step)), key=self.length.__getitem__):
            above = self.whole[self.link[state]] if state else []
            self.whole[state] = above + own.get(state, [])

    def _add(self, length: int, step: dict[str, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, state: int, word: str, target: int) -> int:
        """A copy of ``target`` that holds only its words reached from ``state``."""
        copy = self._add(self.length[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: str) -> int:
        target = self.step[last].get(word)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new = self._add(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.step[state][word]
            fits = self.length[target] == self.length[state] + 1
            self.link[new] = target if fits else self._split(state, word, target)
        return new

    def statistics(self, found: list[str]) -> Iterator[tuple[int, int, int]]:
        """Matching statistics: for each word that ends a match, its place, the state and the longest length."""
        step, link, length, root = self.step, self.link, self.length, self.step[0]
        state = matched = 0
        for at, word in enumerate(found):
            if not state and word not in root:
                continue
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            target = step[state].get(word)
            if target is None:
                matched = 0
                continue
            state = target
            matched += 1
            yield at, state, matched


class Layer:
    """Templates that are matched together, so that a longer match hides no other template that holds the shorter one.
    Notices, clauses and whole licences are layers of their own: a clause is found inside of its licence too."""

    def __init__(
        self,
        templates: Mapping[str, tuple[str, ...]],
        phrases: list[tuple[list[str], str]] = (),
        gap: int = MOST_GAP,
        missing: float = MOST_GAP,
        covered: float = COVERED,
    ):
        self.templates = [(words(t), label) for label, texts in templates.items() for t in texts]
        self.gap, self.missing = gap, missing
        self.least = [len(t) if len(t) <= SHORT_NOTICE else covered * len(t) for t, _ in self.templates]
        self.sizes = [self._whole(sequence, label) for sequence, label in self.templates]
        self.automaton = Automaton([w for w, _ in [*phrases, *self.templates]])
        self.where = self._occurrences()

    def _whole(self, sequence: list[str], label: str) -> int:
        """Words of the longest short licence of the label that the sequence is part of, else its own."""
        part = f" {' '.join(sequence)} "
        licences = [words(text) for text in SHORT.get(label, ())]
        return max([len(sequence), *(len(x) for x in licences if part in f" {' '.join(x)} ")])

    def _occurrences(self) -> list[list[tuple[int, int]]]:
        """For every state that can be chained, each template and end where its words stand."""
        out: list[list[tuple[int, int]]] = [[] for _ in self.automaton.step]
        for number, (sequence, _) in enumerate(self.templates):
            state = 0
            for at, word in enumerate(sequence):
                state = self.automaton.step[state][word]
                up = state
                while up > 0 and self.automaton.length[up] >= LEAST_MATCH:
                    out[up].append((number, at))
                    up = self.automaton.link[up]
        return out

    def matches(self, found: list[str], base: list) -> list[tuple[int, int, int]]:
        """Matches that no longer one contains: place of the last word, state and words. Every state on the way
        where a sequence ends goes to ``base``."""
        ends: list[tuple[int, int, int]] = []
        before = None
        whole = self.automaton.whole
        for at, state, matched in self.automaton.statistics(found):
            if whole[state]:
                base.append((at, state, matched))
            if before and not (before[0] == at - 1 and matched == before[2] + 1) and before[2] >= LEAST_MATCH:
                ends.append(before)
            before = (at, state, matched)
        if before and before[2] >= LEAST_MATCH:
            ends.append(before)
        return ends

    def chains(self, ends: list[tuple[int, int, int]]) -> list[tuple[int, float, str, int, int]]:
        """Heaviest chains of matches that go forward in text and template, for templates covered enough: minus words
        covered, minus share, label, first word, end word.

        Dynamic programming over the matches of a template: a match follows the heaviest chain that ends at most ``gap``
        words before it, and ``missing`` words of the template before it, or starts one. Where no chain can be followed
        any more the heaviest so far is closed, so only the chains of the last ``gap`` words are held.
        """
        open_: dict[int, list[tuple[int, int, int, int]]] = {}  # template: end word, next place, words covered, first word
        heaviest: dict[int, tuple[int, int, int, int]] = {}
        closed: list[tuple[int, float, str, int, int]] = []

        def close(number: int) -> None:
            stop, _, covered, start = heaviest.pop(number)
            if covered >= self.least[number]:
                closed.append((-covered, -covered / self.sizes[number], self.templates[number][1], start, stop))

        for at, state, matched in ends:
            start = at - matched + 1
            added: dict[int, dict[int, tuple[int, int, int, int]]] = {}
            for number, end in self.where[state]:
                if number not in added:
                    added[number] = {}
                    if number in open_:
                        open_[number] = [c for c in open_[number] if c[0] + self.gap >= start]
                        if not open_[number] and heaviest[number][0] <= start:
                            close(number)
                place = end - matched + 1
                before = [
                    c for c in open_.get(number, ()) if c[0] <= start and c[1] <= place and place - c[1] <= self.missing
                ]
                covered, first = max(((c[2], -c[3]) for c in before), default=(0, -start))
                added[number][end] = (at + 1, end + 1, covered + matched, -first)
            for number, new in added.items():
                open_.setdefault(number, []).extend(new.values())
                best = max(new.values(), key=lambda c: (c[2], -c[3]))
                if number not in heaviest or best[2] > heaviest[number][2]:
                    heaviest[number] = best
        for number in list(heaviest):
            close(number)
        return closed


class Scanner:
    """Base places and covered template spans of a text."""

    def __init__(
        self,
        phrases: Mapping[str, str] = PHRASES,
        templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
        licences: tuple[Mapping[str, tuple[str, ...]], ...] = (CLAUSES, WHOLE),
    ):
        self.phrases = [(words(p), label) for p, label in phrases.items()]
        notices = {label: tuple(w for t in texts for w in worded(t)) for label, texts in templates.items()}
        clauses, whole = licences
        whole = Layer(whole, gap=REMARK, missing=math.inf, covered=COVERED_WHOLE)
        self.layers = [Layer(notices, self.phrases), Layer(clauses), whole]
        n = len(self.phrases)
        self.base = [[(k, size) for k, size in whole if k < n] for whole in self.layers[0].automaton.whole]

    def scan(self, text: str) -> dict:
        """Words, base places (start, label), and covered spans (label, first word, end word, share of the template,
        or of the whole licence where the template is part of a short one)."""
        found = words(text)
        closed: list[tuple[int, float, str, int, int]] = []
        base: list[tuple[int, str]] = []
        for number, layer in enumerate(self.layers):
            reached: list[tuple[int, int, int]] = []
            closed += layer.chains(layer.matches(found, reached))
            if number == 0:
                for at, state, matched in reached:
                    base += [(at - size + 1, self.phrases[k][1]) for k, size in self.base[state] if size <= matched]
        return {"n_words": len(found), "base": sorted(base), "spans": self._spans(closed)}

    @staticmethod
    def _spans(closed: list[tuple[int, float, str, int, int]]) -> list[tuple[str, int, int, float]]:
        """Of chains that share words of the text the one that covers most of them stays, ties by share, then label."""
        spans: list[tuple[int, int, str, float]] = []  # by first word, none overlapping
        for _, share, label, start, stop in sorted(closed):
            at = bisect_left(spans, (start,))
            if (not at or spans[at - 1][1] <= start) and (at == len(spans) or stop <= spans[at][0]):
                spans.insert(at, (start, stop, label, -share))
        return [(label, start, stop, share) for start, stop, label, share in spans]


SCANNED = (
    "n_words long, base_labels array<string>, base_starts array<long>, "
    "spans array<struct<label: string, first: long, stop: long, share: double>>"
)


def scan_licences(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
) -> DataFrame:
    """``doc_id`` and what stands in every whole ``text``: ``n_words``, places of the phrases (``base_labels`` and
    ``base_starts``, by start) and covered ``spans`` (label, first word, word after the last, share of the template, for
    part of a short licence share of the whole).

    A null text is empty: no words, no places. Every row gives one row, repeated ones too; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterable) -> Iterator:
        import pyarrow as pa

        scanner = Scanner(phrases, templates)
        span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("stop", pa.int64()), ("share", pa.float64())])
        for batch in slices(batches):
            found = [scanner.scan(text or "") for text in batch.column(1).to_pylist()]
            spans = [[dict(zip(("label", "first", "stop", "share"), s, strict=True)) for s in f["spans"]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f["n_words"] for f in found], pa.int64()),
                    pa.array([[label for _, label in f["base"]] for f in found], pa.list_(pa.string())),
                    pa.array([[start for start, _ in f["base"]] for f in found], pa.list_(pa.int64())),
                    pa.array(spans, pa.list_(span)),
                ],
                names=["doc_id", "n_words", "base_labels", "base_starts", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, {SCANNED}")
