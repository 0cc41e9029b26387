"""Licence scans: matching statistics against a generalised suffix automaton of licence tokens, chained into spans."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.shared import small_batches, table, unused

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A match of so many tokens can take part in a span; shorter ones are chance.
MIN_MATCH = 4
#: Tokens that may lie between two matches of one span, in the text and in the template.
MAX_GAP = 12
#: A span counts for its template if it matches so many tokens, or all of a shorter template.
MIN_SPAN = 6
#: A template counts as present if its spans together cover this share of it.
MIN_COVER = 0.6

# Phrases and labels of the query's contract.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Notices and texts of well-known public licences.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-disclaimer": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-no-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-notice": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def words_of(text: str) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of digits, a-z and characters beyond ASCII."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


@dataclass(frozen=True)
class Span:
    template: str
    first_word: int
    n_words: int
    n_matched: int
    template_start: int
    template_words: int


class LicenseAutomaton:
    """A suffix automaton over the token sequences of all templates and phrases.

    Each state keeps the templates that hold its strings, with all places, and
    the phrases that end in them.
    """

    def __init__(self, templates: dict[str, str], phrases: Iterable[str]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = list(templates)
        self.sizes = [len(words_of(t)) for t in templates.values()]
        self.phrases = [words_of(p) for p in phrases]
        texts = [words_of(t) for t in templates.values()]
        for words in [*texts, *self.phrases]:
            last = 0
            for w in words:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
        # where the templates hold a state's strings: template and their last token's place, for strings that can be a match
        self.held: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for k, words in enumerate(texts):
            state = 0
            for at, w in enumerate(words):
                state = v = self.next[state][self.vocabulary[w]]
                while self.length[v] >= MIN_MATCH:
                    self.held[v].append((k, at))
                    v = self.link[v]
        self.phrase_at: dict[int, list[int]] = defaultdict(list)
        for k, words in enumerate(self.phrases):
            state = 0
            for w in words:
                state = self.next[state][self.vocabulary[w]]
            self.phrase_at[state].append(k)
        # phrases that end wherever a state's strings end, nearest state first
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = tuple((k, len(self.phrases[k])) for k in self.phrase_at.get(v, ()))
            self.ends[v] = own + self.ends[self.link[v]]

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, c, known)
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, moves: dict[int, int], length: int, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], list[Span]]:
        """n_words, phrase places (start, phrase) and covered spans of a text.

        The matching statistic of a place is the longest stretch ending there
        that stands in some template.  Words outside the vocabulary reset it, so
        the walk only visits the rest.  Maximal matches of MIN_MATCH tokens or
        more, at every place that they have in a template, are chained per template.
        """
        words = words_of(text)
        ids = list(map(self.vocabulary.get, words))
        state = size = 0
        before = -2
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int, int]] = []  # template, its start, the text's start, tokens
        moves, link, length, ends = self.next, self.link, self.length, self.ends

        def close(at: int) -> None:
            if size >= MIN_MATCH:
                matches.extend((k, e - size + 1, at - size + 1, size) for k, e in self.held[state])

        for i, c in enumerate(ids):
            if c is None:
                continue
            if i != before + 1:
                close(before)
                state = size = 0
            before = i
            if c not in moves[state]:
                close(i - 1)
                while state and c not in moves[state]:
                    state = link[state]
                size = min(size, length[state])
            if c in moves[state]:
                state = moves[state][c]
                size += 1
            for k, m in ends[state]:
                if m <= size:
                    places.append((i - m + 1, k))
        close(before)
        return len(words), places, self._chain(matches)

    def _chain(self, matches: list[tuple[int, int, int, int]]) -> list[Span]:
        by_template: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, t, x, n in matches:
            by_template[k].append((x, t, n))
        spans = [Span(self.names[k], *found) for k, own in by_template.items() for found in chains(own)]
        return sorted(spans, key=lambda s: (s.first_word, s.template))

    def covers(self, spans: list[Span]) -> dict[str, float]:
        """Share of each template that its spans of MIN_SPAN tokens (or a whole shorter template) cover together; where they overlap it counts once."""
        sizes = dict(zip(self.names, self.sizes, strict=True))
        by_template: dict[str, list[Span]] = defaultdict(list)
        for s in spans:
            if s.n_matched >= min(MIN_SPAN, sizes[s.template]):
                by_template[s.template].append(s)
        out = {}
        for name, own in by_template.items():
            total, upto = 0.0, 0
            for s in sorted(own, key=lambda s: s.template_start):
                a, z = max(s.template_start, upto), s.template_start + s.template_words
                if z > a:  # a span's matched tokens are spread evenly over what it spans
                    total += s.n_matched * (z - a) / s.template_words
                    upto = z
            out[name] = total / sizes[name]
        return out


def chains(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Spans (first word, words, matched, template start, template words) of one template from its matches (text start, template start, tokens).

    A match may follow another at most MAX_GAP tokens on in both text and
    template; where they overlap in either, the later one loses the overlap.
    Each match knows the best chain that ends in it; the chains are taken in
    order of what they match, each up to where an earlier one has the text.
    """
    own = sorted(matches)
    longest = max((n for _, _, n in own), default=0)
    gain: list[int] = []
    before: list[int | None] = []
    for i, (x, t, n) in enumerate(own):
        gain.append(n)
        before.append(None)
        for j in range(i - 1, -1, -1):
            px, pt, pn = own[j]
            if px < x - MAX_GAP - longest:
                break
            cut = max(px + pn - x, pt + pn - t, 0)
            on = x + n > px + pn and t + n > pt + pn and cut < n and px < x + cut and pt < t + cut
            if on and x - px - pn <= MAX_GAP and t - pt - pn <= MAX_GAP and gain[j] + n - cut > gain[i]:
                gain[i], before[i] = gain[j] + n - cut, j
    starts: list[int] = []
    ends: list[int] = []
    out = []

    def free(a: int, z: int) -> bool:
        at = bisect_left(ends, a + 1)
        return at == len(starts) or starts[at] >= z

    for last in sorted(range(len(own)), key=lambda i: (-gain[i], i)):
        x1 = own[last][0] + own[last][2]
        if not free(own[last][0], x1):
            continue
        first = last
        while (j := before[first]) is not None and free(own[j][0], x1):
            first = j
        x0, t0, n0 = own[first]
        at = bisect_left(starts, x0)
        starts.insert(at, x0)
        ends.insert(at, x1)
        out.append((x0, x1 - x0, gain[last] - gain[first] + n0, t0, own[last][1] + own[last][2] - t0))
    return out


SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<template:string,first_word:long,n_words:long,n_matched:long,template_start:long,template_words:long>>"
_AUTOMATA: dict[str, LicenseAutomaton] = {}


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """Adds what licences stand in every text: phrase places, labels, a score and the covered spans.

    labels are those of the phrases and of the templates covered by MIN_COVER or
    more; the score is the largest share of a template that its spans cover
    together, 1 where a phrase stands.  A null text is empty: no words, no
    labels, score 0.
    Repeated rows stay; input columns named like an added one are replaced.
    """
    templates, phrases = templates or TEMPLATES, phrases or BASE_PHRASES
    small_batches(docs.sparkSession)

    @F.pandas_udf(SCAN)
    def found(texts: pd.Series) -> pd.DataFrame:
        key = repr((templates, phrases))
        a = _AUTOMATA.get(key) or _AUTOMATA.setdefault(key, LicenseAutomaton(templates, phrases))
        named = list(phrases.values())
        rows = []
        for t in texts:
            n, places, spans = a.scan(t or "")
            base = {named[k] for _, k in places}
            cover = a.covers(spans)
            own = {k for k, v in cover.items() if v >= MIN_COVER}
            starts = [s for s, _ in places]
            score = 1.0 if base else min(1.0, max(cover.values(), default=0.0))
            rows.append((n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score, [vars(s) for s in spans]))
        out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    (scanned,) = unused(docs, "scanned")
    return docs.withColumn(scanned, found(F.col(text))).withColumns({c: F.col(scanned)[c] for c in names}).drop(scanned)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
