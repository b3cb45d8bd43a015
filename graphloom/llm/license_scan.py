"""Licence scans by a generalised suffix automaton of licence tokens.

The templates are whole licence texts, read from the folder ``licences``, and
notices.  All go into one automaton.  A text is streamed through it word by
word, which gives the longest run of template words that ends at each place.
Long matches are chained by dynamic programming over their places in text and
template into the span of a template they cover best, and a span that covers
enough of its template labels the document.  Words that lie within a longer run
of another template go to that one.  The four base phrases are looked up
besides, compared word by word, and always count.

Only runs of at least MIN_MATCH words that occur in some template can hold a
match, so the automaton walks those runs and skips the rest.

Edge cases: a null text is an empty one, without words or labels.  Rows that
repeat a doc_id are scanned each; a null doc_id is returned.  An empty table
gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import LETTERS, Words, documents, hash_bytes, id_text, spread, texts, words

#: The base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Opening words of well-known public licence texts and notices, and their labels.
NOTICES = (
    ("mit-notice", "Released under the MIT License."),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0-header",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "bsd-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    (
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl-2.0-header",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
#: All templates: the notices, and the whole texts of the folder, named by their files.
TEMPLATES = NOTICES + tuple(
    (f.name.removesuffix(".txt"), f.read_text())
    for f in sorted((files(__package__) / "licences").iterdir(), key=lambda f: f.name)
)
MIN_MATCH = 5
MAX_GAP = 4
MIN_COVER = 0.75

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


class Automaton:
    """Generalised suffix automaton over the word ids of all templates."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((number, at))
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]

    def _state(self, size: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.size.append(size)
        self.link.append(link)
        self.ends.append(set())
        return len(self.size) - 1

    def _split(self, parent: int, word: int) -> int:
        """The state that parent reaches by word, made to be exactly one word longer."""
        target = self.next[parent][word]
        if self.size[target] == self.size[parent] + 1:
            return target
        twin = self._state(self.size[parent] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = twin
        while parent >= 0 and self.next[parent].get(word) == target:
            self.next[parent][word] = twin
            parent = self.link[parent]
        return twin

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        state = self._state(self.size[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            self.link[state] = self._split(at, word)
        return state

    def matches(self, run: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the longest matches of at least ``least`` words that do not go on."""
        state = length = 0
        for at, word in enumerate(run):
            if word not in self.next[state]:
                if length >= least:
                    yield at, length, state
                while state and word not in self.next[state]:
                    state = self.link[state]
                length = self.size[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
        if length >= least:
            yield len(run), length, state


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, min_match=MIN_MATCH, max_gap=MAX_GAP, min_cover=MIN_COVER):
        self.labels = [label for label, _ in templates]
        spelled = [tokens(text) for _, text in templates]
        known = sorted({w for s in spelled for w in s} | {w for p, _ in phrases for w in tokens(p)})
        number = {w: k for k, w in enumerate(known)}
        self.sequences = [[number[w] for w in s] for s in spelled]
        self.automaton = Automaton(self.sequences)
        self.phrases = [([number[w] for w in tokens(p)], tokens(p), label) for p, label in phrases]
        hashes = np.array([hash_bytes(w) for w in known], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order.astype(np.int64)
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover

    def ids(self, w: Words) -> np.ndarray:
        """The number of each word that a template or phrase has, else -1."""
        at = np.minimum(np.searchsorted(self.hashes, w.hash), len(self.hashes) - 1)
        return np.where(self.hashes[at] == w.hash, self.number[at], -1)

    def runs(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of known words within a row that may hold a match."""
        known = np.zeros(len(ids) + 2, bool)
        known[1:-1] = ids >= 0
        begins, ends = known[1:-1] & ~known[:-2], known[1:-1] & ~known[2:]
        inner = first[(first > 0) & (first < len(ids))]
        begins[inner] = known[1:-1][inner]
        ends[inner - 1] = known[1:-1][inner - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long = end - start >= self.min_match
        return start[long], end[long]

    def cover(self, runs: list[tuple[int, list[int]]]) -> list[tuple[str, float, int, int]]:
        """label, share of the template covered, first and last word, of the best chain of each template.

        runs: (place of the first word, word numbers).  A chain goes on with a
        match that begins at most max_gap words after it, both in the text and in
        the template; words that both have count once.  Chains that a later match
        can still reach are kept, the best for each place in the template.
        """
        open_: dict[int, dict[int, tuple[int, int, int]]] = {}  # template -> its place -> (covered, end in the text, first word)
        best: dict[int, tuple[float, int, int]] = {}
        gap = self.max_gap
        for place, run in runs:
            for end, length, state in self.automaton.matches(run, self.min_match):
                start, stop = place + end - length, place + end
                for number, last in self.automaton.ends[state]:
                    from_, to = last - length + 1, last + 1
                    chains = open_.setdefault(number, {})
                    top = (length, stop, start)
                    for at, (covered, until, first) in list(chains.items()):
                        if until + gap < start:
                            del chains[at]
                            continue
                        both = max(0, until - start, at - from_)
                        if both < length and start + both - until <= gap and from_ + both - at <= gap:
                            top = max(top, (covered + length - both, stop, first))
                    chains[to] = max(top, chains.get(to, top))
                    share = top[0] / len(self.sequences[number])
                    if share > best.get(number, (0.0,))[0]:
                        best[number] = (share, top[2], stop - 1)
        return [(self.labels[k], *best[k]) for k in sorted(best)]

    def batch(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        t = texts(batch.column(1))
        n = len(t)
        out = {
            "n_words": np.zeros(n, np.int64), "n_base": np.zeros(n, np.int64),
            "first_word": np.full(n, -1, np.int64), "last_word": np.full(n, -1, np.int64),
        }
        base: list[set[str]] = [set() for _ in range(n)]
        found: list[list[tuple[str, float, int, int]]] = [[] for _ in range(n)]
        for a, b in t.chunks():
            w = words(t, a, b, LETTERS)
            out["n_words"][a:b] = np.diff(w.first)
            ids = self.ids(w)
            some = np.flatnonzero(ids >= 0)
            if not len(some):
                continue
            row_of = w.row_of()
            for phrase, spelled, label in self.phrases:
                at = some[ids[some] == phrase[0]]
                at = at[at + len(phrase) <= w.first[1:][row_of[at]]]
                for j, word in enumerate(phrase[1:], 1):
                    at = at[ids[at + j] == word]
                for p in at.tolist():
                    if any(w.bytes[w.start[p + j] : w.end[p + j]].tobytes() != x for j, x in enumerate(spelled)):
                        continue
                    row, place = int(row_of[p]), int(p - w.first[row_of[p]])
                    i = row + a
                    base[i].add(label)
                    out["n_base"][i] += 1
                    low = out["first_word"][i]
                    out["first_word"][i] = place if low < 0 else min(low, place)
                    out["last_word"][i] = max(out["last_word"][i], place)
            runs: dict[int, list[tuple[int, list[int]]]] = {}
            for s, e in zip(*self.runs(ids, w.first), strict=True):
                row = int(row_of[s])
                runs.setdefault(row, []).append((int(s - w.first[row]), ids[s:e].tolist()))
            for row, own in runs.items():
                found[row + a] = [x for x in self.cover(own) if x[1] >= self.min_cover]
        spans = pa.array(
            [[{"label": x[0], "cover": x[1], "first": x[2], "last": x[3]} for x in own] for own in found], _SPANS
        )
        columns = {k: pa.array(v, pa.int64(), mask=v < 0) for k, v in out.items()}
        columns["base_labels"] = pa.array([",".join(sorted(x)) for x in base], pa.string())
        columns["labels"] = pa.array(
            [",".join(sorted(x | {s[0] for s in own})) for x, own in zip(base, found, strict=True)], pa.string()
        )
        columns["score"] = pa.array(
            [max([0.0, *(min(1.0, s[1]) for s in own), *([0.5] if x else [])]) for x, own in zip(base, found, strict=True)],
            pa.float64(),
        )
        return pa.RecordBatch.from_arrays([batch.column(0), *columns.values(), spans], ["doc_id", *columns, "spans"])


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("cover", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))
_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,cover:double,first:long,last:long>>"
)


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per row of docs: words, places of base phrases, labels, and the covered template spans.

    score is the largest share of a template that a chain covers; a base phrase
    alone gives 0.5.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            yield scanner.batch(batch)

    return spread(id_text(docs)).mapInArrow(run, _SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("spans")
