"""Licence scans: matching statistics on a generalised suffix automaton of licence templates.

One automaton holds every substring of all templates' words. A file is streamed
through it word by word; at each word the state is that of the longest run ending
there that some template contains. Where such a run ends and is long, it is a match,
and matches that follow each other in a template's order are chained into a span of
the file that covers a share of the template. Short phrases are looked up in the same
pass: a phrase ends where its state is the current one or a suffix of it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.llm.text import alnum_words, as_bytes

# Phrases that give a label wherever they stand.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Texts of licences and of the notices that name them.
TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
    to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
    whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
    notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
    WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
    PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
    OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
    SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Released under the terms of the MIT License"),
    ("mit", "This source code is licensed under the MIT license found in the LICENSE file in the root directory of this source tree."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
    with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
    applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
    WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
    permissions and limitations under the License."""),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
    License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
    This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
    of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
    received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("gpl", "Licensed under the GNU General Public License"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
    Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
    version."""),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
    list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("bsd", """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
    INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
    IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
    CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
    PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
    TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
    POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
    granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
    distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
    use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
    commercial or non-commercial, and by any means."""),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)


@dataclass(frozen=True)
class Settings:
    """shortest: words of a match. gap: words between matches of a chain. share: of a template's words that a span must cover for its label."""

    shortest: int = 4
    gap: int = 30
    share: float = 0.6


class Span(NamedTuple):
    """Words `start` to `end` (exclusive) of a file that cover a share of a template."""

    template: int
    start: int
    end: int
    covered: float


class Automaton:
    """All substrings of all templates and phrases; a state stands for those that end at the same places.

    next: by state, the state after a word. link: the state of the longest suffix that
    has other ends. length: of a state's longest substring. ends: by state, the places
    (template, words before the end) of its substrings, of long ones only. phrases: by
    state, (length, phrase) of the phrases that are suffixes of its longest substring.
    """

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], shortest: int):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.labels = [label for label, _ in templates]
        self.sizes, last = [], {}
        placed: list[list[tuple[int, int]]] = [[]]
        for t, (_, text) in enumerate(templates):
            words = words_of(text)
            self.sizes.append(len(words))
            state = 0
            for k, word in enumerate(words):
                state = self._extend(state, word, placed)
                placed[state].append((t, k + 1))
        for p, (phrase, _) in enumerate(phrases):
            state = 0
            for word in words_of(phrase):
                state = self._extend(state, word, placed)
            last.setdefault(state, []).append((len(words_of(phrase)), p))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.phrases: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for v in order:  # suffixes first
            self.phrases[v] = self.phrases[self.link[v]] + tuple(last.get(v, ()))
        for v in reversed(order):
            placed[self.link[v]] += placed[v]
        self.ends = [tuple(sorted(set(x))) if self.length[v] >= shortest else () for v, x in enumerate(placed)]

    def _state(self, length: int, link: int, after: dict[bytes, int], placed: list) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(after)
        placed.append([])
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, placed: list) -> int:
        """The state of exactly the longest substring of `p` and `word`, taken out of the one that follows if that is longer."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), placed)
        self.link[q] = part
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = part
            p = self.link[p]
        return part

    def _extend(self, state: int, word: bytes, placed: list) -> int:
        if word in self.next[state]:
            return self._split(state, word, placed)
        new, p = self._state(self.length[state] + 1, 0, {}, placed), state
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word, placed)
        return new


class Chains:
    """Chains of matches in one file, by template; what it holds is bounded by the templates, not the file."""

    def __init__(self, sizes: list[int], s: Settings):
        self.sizes, self.s = sizes, s
        self.open: dict[int, dict[int, tuple[int, int, int]]] = {}  # template: end in it: (words covered, start, end in the file)
        self.share = 0.0
        self.spans: list[Span] = []

    def add(self, end: int, length: int, places: Sequence[tuple[int, int]]) -> None:
        """A match of `length` words before `end`, at its places in templates; matches come by their ends."""
        for t, t_end in places:
            chains = self.open.setdefault(t, {})
            if chains and end - length - max(x[2] for x in chains.values()) > self.s.gap:
                self._close(t)
                chains = self.open[t] = {}
            best = max(chains.values(), default=None)
            if best is not None and best[0] == self.sizes[t] and end - length >= best[2]:
                # complete: what follows is another copy
                self._close(t)
                chains = self.open[t] = {}
            found = (length, end - length, end)
            for before, (covered, start, stop) in chains.items():
                # a chain may lose the words that both matches have
                new = min(length, t_end - before, end - stop)
                if new > 0 and end - length - stop <= self.s.gap and covered + new > found[0]:
                    found = (covered + new, start, end)
            if found > chains.get(t_end, (0, 0, 0)):
                chains[t_end] = found

    def _close(self, t: int) -> None:
        covered, start, end = max(self.open.pop(t).values())
        share = covered / self.sizes[t]
        self.share = max(self.share, share)
        if share >= self.s.share:
            self.spans.append(Span(t, start, end, share))

    def close(self) -> None:
        for t in list(self.open):
            self._close(t)


class Found(NamedTuple):
    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base: set[int]
    share: float
    spans: list[Span]


def scan(words: Iterator[list[bytes]], a: Automaton, s: Settings) -> Found:
    """Phrases and spans of one file, streamed through the automaton."""
    after, link, length, ends, phrases = a.next, a.link, a.length, a.ends, a.phrases
    chains = Chains(a.sizes, s)
    state = size = at = n_base = 0
    first = last = None
    base: set[int] = set()
    for some in words:
        for word in some:
            to = after[state].get(word)
            if to is None:
                if not state:
                    at += 1
                    continue
                if size >= s.shortest:
                    chains.add(at, size, ends[state])
                while state and to is None:
                    state = link[state]
                    size = length[state]
                    to = after[state].get(word)
                if to is None:
                    at += 1
                    continue
            state = to
            size += 1
            at += 1
            for n, phrase in phrases[state]:
                if n <= size:
                    n_base += 1
                    base.add(phrase)
                    last = at - n if last is None else max(last, at - n)
                    first = at - n if first is None else min(first, at - n)
    if size >= s.shortest:
        chains.add(at, size, ends[state])
    chains.close()
    return Found(at, n_base, first, last, base, 1.0 if base else chains.share, chains.spans)


def words_of(text: str) -> list[bytes]:
    return [w for some in alnum_words(text.encode()) for w in some]


FOUND = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, template: int, first_word: long, end_word: long, covered: double>>"
)


def scan_licenses(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, s: Settings = Settings()
) -> DataFrame:
    """A row for each row of `docs`: `row`, a struct of all columns but the text, and the columns of FOUND.

    base_labels are those of the phrases that stand in the text, labels these and those
    of the spans; score is the largest share of a template that a chain covers, 1 where
    a phrase stands. Both (label, text) lists can be others. Places of a phrase may
    overlap and all count. Spans of several templates may overlap. Of a template, what
    follows another copy without a gap is a span of its own if that copy is complete,
    else the better of the two counts.

    Whole texts are streamed; a null or empty text has no words, empty labels, null
    places and score 0. Rows are scanned one by one, so repeated rows and ties need no
    rule; extra columns are in `row`, so their names clash with nothing, and an empty
    table gives an empty one. The automaton is made once for a task and no shuffle is
    needed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Automaton(templates, phrases, s.shortest)
        for batch in batches:
            rows = []
            for data in as_bytes(batch.column(1)):
                x = scan(alnum_words(data or b""), a, s)
                base = {phrases[p][1] for p in x.base}
                spans = [{"label": a.labels[t], "template": t, "first_word": b, "end_word": e, "covered": c} for t, b, e, c in x.spans]
                labels = base | {y["label"] for y in spans}
                rows.append((*x[:4], ",".join(sorted(base)), ",".join(sorted(labels)), x.share, spans))
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    span = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.float64())])
    kinds = [*([pa.int64()] * 4), pa.string(), pa.string(), pa.float64(), pa.list_(span)]
    names = ["row", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    rows = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {FOUND}")
