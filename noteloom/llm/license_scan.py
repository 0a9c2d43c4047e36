"""License scans with a generalised suffix automaton over license words (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Excerpts of public license notices, some of them openings only, and no license bodies: (label, text). A text that holds
#: other parts of a license only, such as its numbered sections, gets no label from them.
TEMPLATES = (
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-notice", "Released under the MIT License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("no-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
)

#: A match counts for a span from so many words, or when it is a whole template; matches of one template not farther apart in the text are chained.
LEAST_WORDS, GAP = 5, 8
#: A template's label is given when its chained spans cover at least this share of its words.
COVERED = 0.6

#: Bytes that are no words become spaces, A-Z become a-z: word bytes are digits, letters and all above 7F.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences; `paths` has the states of each one's prefixes."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.paths = []
        for words in sequences:
            last, path = 0, []
            for w in words:
                last = self._add(last, w)
                path.append(last)
            self.paths.append(path)

    def _state(self, nxt: dict, link: int, length: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:  # another sequence has these words
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        cur, p = self._state({}, 0, self.length[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return cur

    def state_of(self, words: list[bytes]) -> int:
        s = 0
        for w in words:
            s = self.next[s][w]
        return s

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(word index, state, length of the longest match that ends there), where a match ends."""
        s = n = 0
        nxt, link, length = self.next, self.link, self.length
        for i, w in enumerate(words):
            t = nxt[s].get(w)
            if t is None:
                if not s:
                    continue
                while s and (t := nxt[s].get(w)) is None:
                    s = link[s]
                    n = length[s]
                if not s:
                    t = nxt[0].get(w)
                if t is None:
                    s = n = 0
                    continue
            s, n = t, n + 1
            yield i, s, n


@dataclass(frozen=True)
class Found:
    n_words: int
    places: tuple[tuple[int, str], ...]  # (start, label) of the phrases
    spans: tuple[tuple[str, int, int, float], ...]  # (template, first word, end, share of the template)


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.labels = [x for _, x in phrases]
        self.names = [x for x, _ in templates]
        self.phrases = [words_of(p) for p, _ in phrases]
        self.templates = [words_of(t) for _, t in templates]
        a = self.automaton = Automaton(self.templates + self.phrases)
        # the phrases and short templates whose words end a state's words, by its suffix links
        whole: dict[int, list[int]] = {}
        self.wholes = [*self.phrases, *(t for t in self.templates if len(t) < LEAST_WORDS)]
        short = [k for k, t in enumerate(self.templates) if len(t) < LEAST_WORDS]
        for k, p in enumerate(self.wholes):
            whole.setdefault(a.state_of(p), []).append(k)
        self.ends = [()] * len(a.next)
        below: list[list[int]] = [[] for _ in a.next]
        for s in sorted(range(1, len(a.next)), key=lambda s: a.length[s]):
            self.ends[s] = (*whole.get(s, ()), *(self.ends[a.link[s]] if a.link[s] > 0 else ()))
            below[a.link[s]].append(s)
        self.short_of = {len(self.phrases) + i: k for i, k in enumerate(short)}
        # each prefix of a template ends at one state; in the order of the link tree the places of a state's words lie together
        own: list[list[tuple[int, int]]] = [[] for _ in a.next]
        for t, path in enumerate(a.paths[: len(self.templates)]):
            for i, s in enumerate(path):
                own[s].append((t, i + 1))
        self.at: list[tuple[int, int]] = []
        self.low, self.high = [0] * len(a.next), [0] * len(a.next)
        stack = [(0, False)]
        while stack:
            s, left = stack.pop()
            if left:
                self.high[s] = len(self.at)
                continue
            self.low[s] = len(self.at)
            self.at += own[s]
            stack.append((s, True))
            stack += [(c, False) for c in below[s]]

    def places_of(self, s: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(template, end, length) of all places where a template's words before the end equal the last ones of the text,
        as many as go, LEAST_WORDS or more."""
        link, length = self.automaton.link, self.automaton.length
        lo = hi = self.low[s]
        while s > 0 and n >= LEAST_WORDS:
            for k in (*range(self.low[s], lo), *range(hi, self.high[s])):
                yield *self.at[k], n
            lo, hi = self.low[s], self.high[s]
            s = link[s]
            n = length[s]

    def scan(self, text: str | None) -> Found:
        words = words_of(text)
        places, spans, parts = [], [], {}
        for i, s, n in self.automaton.statistics(words):
            for k in self.ends[s]:
                if n >= len(self.wholes[k]):
                    start = i - len(self.wholes[k]) + 1
                    if k < len(self.phrases):
                        places.append((start, self.labels[k]))
                    else:
                        spans.append((self.names[self.short_of[k]], start, i + 1, 1.0))
            if n >= LEAST_WORDS:
                after = words[i + 1] if i + 1 < len(words) else None
                for t, end, m in self.places_of(s, n):
                    of = self.templates[t]
                    if end == len(of) or of[end] != after:  # a match is as long as it gets
                        parts.setdefault(t, []).append((i - m + 1, end - m, m))
        for t, found in parts.items():
            spans += [(self.names[t], a, e, n / len(self.templates[t])) for a, e, n in chains(found, COVERED * len(self.templates[t]))]
        return Found(len(words), tuple(sorted(places)), tuple(sorted(spans, key=lambda x: (x[1], x[0], x[2]))))


def chains(matches: list[tuple[int, int, int]], least: float, gap: int | None = None) -> list[tuple[int, int, int]]:
    """(first word, end, words covered) of the best chains that cover least words or more, none over another's words.

    A match is (start in the text, start in the template, length). A chain's matches follow each other in both; where
    one begins before the last one ends, in either, only its words after that count. In the text at most gap words lie
    between them, in the template any number. The best chain is the one that covers most words, by dynamic programming
    over the matches; ties go to the one that ends, then starts, first.
    """
    gap = GAP if gap is None else gap
    done: list[tuple[int, int, int, int, int]] = []  # covered words, first word, end of each best chain; its match
    active: list[int] = []
    matches = sorted(matches)
    for start, at, n in matches:
        best, first = n, start
        active = [j for j in active if matches[j][0] + matches[j][2] + gap >= start]
        for j in active:
            s, a, m = matches[j]
            over = max(0, s + m - start, a + m - at)
            if over < n and start - (s + m) <= gap and (start > s or at > a) and start >= s and at >= a and done[j][0] + n - over > best:
                best, first = done[j][0] + n - over, done[j][1]
        active.append(len(done))
        done.append((best, first, start + n, at, len(done)))
    out: list[tuple[int, int, int]] = []
    for n, a, e, *_ in sorted((d for d in done if d[0] >= least), key=lambda d: (-d[0], d[2], d[1])):
        if all(e <= x or a >= y for x, y, _ in out):
            out.append((a, e, n))
    return out


_scanners: dict = {}


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """License phrases and covered license templates of every whole text.

    Returns one row per input row: id, n_words, n_base (places of the phrases), first_word and last_word (their
    smallest and largest start, else null), base_labels, labels (with those of covered templates; both distinct,
    sorted, comma-joined, empty if none), score (the largest covered share of a template, 1 for a phrase alone has
    0.5; 0 if nothing is found), spans (array of template, first_word, end_word, share). A null or empty text has no
    words. Null ids and repeated rows are rows like any other; other columns are ignored; an empty table gives no
    rows. The automaton is built once for each worker; texts stream through it without a shuffle.
    """
    key = (tuple(phrases), tuple(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanners.get(key) or _scanners.setdefault(key, Scanner(*key))
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for text in b.column(1):
                f = scanner.scan(text.as_py())
                starts = [s for s, _ in f.places]
                base = sorted({x for _, x in f.places})
                every = sorted({*base, *(s[0] for s in f.spans)})
                score = max([0.5 if base else 0.0, *(s[3] for s in f.spans)])
                spans = [{"template": t, "first_word": a, "end_word": e, "share": r} for t, a, e, r in f.spans]
                for c, v in zip(cols, (f.n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(every), score, spans)):
                    c.append(v)
            span = pa.list_(pa.struct([("template", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("share", pa.float64())]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[b.schema.names[0], *names])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<template: string, first_word: long, end_word: long, share: double>>"
    return df.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, schema)
