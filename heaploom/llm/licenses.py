"""Licence scans: matching statistics over a generalised suffix automaton of licence tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES

#: Phrases whose every place counts, and their labels (fixed by the contract of the query).
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Templates: public licence notices (fixed texts), by label.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "SPDX-License-Identifier: ISC",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "cc-by": [
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
    ],
    "all-rights-reserved": ["Copyright (c). All rights reserved."],
}

#: Shorter matches are chance: function words of ordinary prose.
MIN_MATCH = 3
#: Words that may differ between two matches of one chain.
MAX_GAP = 12
#: A template counts as present if so much of it is covered.
MIN_COVER = 0.6

_WORDS = re.compile(WORD_BYTES)


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased."""
    return _WORDS.findall(text.encode().lower())


def telling_places(texts: list[tuple[str, list[bytes]]]) -> list[set[tuple[int, int]]]:
    """For each template the places (first, end) of what tells it from the templates of other labels.

    For an SPDX line this is the name after the colon; else the words that stand under no other label, or
    where there are none, such pairs of words.
    """
    out = []
    for label, words in texts:
        if words[:3] == [b"spdx", b"license", b"identifier"]:
            out.append({(3, 4)})
            continue
        for n in (1, 2):
            others = {tuple(w[k : k + n]) for other, w in texts if other != label for k in range(len(w) - n + 1)}
            places = {(k, k + n) for k in range(len(words) - n + 1) if tuple(words[k : k + n]) not in others}
            if places:
                break
        out.append(places or {(0, 0)})
    return out


class SuffixAutomaton:
    """All substrings of several token sequences, with where each first ends in each of them."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].setdefault(number, at)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            above = self.ends[self.link[state]]
            for number, at in self.ends[state].items():
                above[number] = min(at, above.get(number, at))
        self.places = self._places(sequences)

    def _places(self, sequences: list[list[int]]) -> list[set[tuple[int, int]]]:
        """All (sequence, end) of each state."""
        places: list[set[tuple[int, int]]] = [set() for _ in self.length]
        for number, sequence in enumerate(sequences):
            state = 0
            for at, token in enumerate(sequence):
                state = self.next[state][token]
                places[state].add((number, at))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            places[self.link[state]] |= places[state]
        return places

    def suffixes(self, state: int, least: int) -> list[tuple[int, int, int]]:
        """(sequence, end, length) where only a shorter suffix of the state's strings stands, of at least ``least``."""
        out, seen = [], self.places[state]
        while self.length[state := self.link[state]] >= least:
            out += [(number, at, self.length[state]) for number, at in sorted(self.places[state] - seen)]
            seen = self.places[state]
        return out

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """The state of the longest string of p plus token, made out of q if q holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token, self.next[last][token])
        new, p = self._new(self.length[last] + 1), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, token, self.next[p][token])
        return new

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """For each place the length of the longest match that ends there, and its state."""
        state = length = 0
        nxt, link, longest = self.next, self.link, self.length
        for token in tokens:
            while state and token not in nxt[state]:
                state = link[state]
                length = longest[state]
            if token in nxt[state]:
                state, length = nxt[state][token], length + 1
            yield length, state


class LicenseScanner:
    """Base phrases and template spans of one text after another."""

    def __init__(self, templates: dict[str, list[str]] | None = None, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER):
        texts = [(label, words_of(t)) for label, ts in (templates or TEMPLATES).items() for t in ts]
        self.labels = [label for label, _ in texts]
        self.sizes = [len(w) for _, w in texts]
        self.telling = telling_places(texts)
        phrases = {p: [w.encode() for w in p.split()] for p in BASE_PHRASES}
        self.ids: dict[bytes, int] = {}
        for word in [w for _, ws in texts for w in ws]:
            self.ids.setdefault(word, len(self.ids) + 1)
        self.words_in_templates = len(self.ids)
        for word in [w for ws in phrases.values() for w in ws]:
            self.ids.setdefault(word, len(self.ids) + 1)
        self.phrases = [([self.ids[w] for w in ws], BASE_PHRASES[p]) for p, ws in phrases.items()]
        self.automaton = SuffixAutomaton([[self.ids[w] for w in ws] for _, ws in texts])
        self.suffixes: dict[int, list[tuple[int, int, int]]] = {}
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover

    def base(self, ids: np.ndarray) -> tuple[list[int], set[str]]:
        starts, labels = [], set()
        for phrase, label in self.phrases:
            at = np.flatnonzero(ids[: len(ids) - len(phrase) + 1] == phrase[0]) if len(ids) >= len(phrase) else np.array([], int)
            for k, word in enumerate(phrase[1:], 1):
                at = at[ids[at + k] == word]
            if len(at):
                starts += at.tolist()
                labels.add(label)
        return starts, labels

    def matches(self, ids: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """For each template all maximal matches of at least min_match words: (start, start in the template, length)."""
        known = (ids > 0) & (ids <= self.words_in_templates)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
        found: dict[int, list[tuple[int, int, int]]] = {}

        def ended(before: dict[tuple[int, int], int], now: dict[tuple[int, int], int], at: int) -> None:
            for (number, end), length in before.items():
                if (number, end + 1) not in now:
                    found.setdefault(number, []).append((at - length, end - length + 1, length))

        for lo, hi in edges.reshape(-1, 2).tolist():
            if hi - lo < self.min_match:
                continue
            before: dict[tuple[int, int], int] = {}
            for at, (length, state) in enumerate(self.automaton.statistics(ids[lo:hi].tolist()), lo):
                now: dict[tuple[int, int], int] = {}
                if length >= self.min_match:
                    if state not in self.suffixes:
                        self.suffixes[state] = self.automaton.suffixes(state, self.min_match)
                    now = dict.fromkeys(self.automaton.places[state], length) | {(number, end): shorter for number, end, shorter in self.suffixes[state]}
                if before:
                    ended(before, now, at)
                before = now
            ended(before, {}, hi)
        return found

    def chains(self, found: dict[int, list[tuple[int, int, int]]]) -> list[tuple[int, int, int, float]]:
        """Best chains of matches that follow each other in text and template: (template, start, end, cover).

        The best chain to each match comes from any match before it that fits; others are passed over.  Chains
        that hold nothing that tells the template from those of other labels are left out, and the rest is taken from the highest cover on, and do not overlap within a template.
        """
        spans = []
        for number, hits in found.items():
            hits.sort()
            cover, origin, tells = [], [], []
            open_: list[int] = []  # matches that a later one can still follow
            for k, (start, at, length) in enumerate(hits):
                open_ = [j for j in open_ if start - hits[j][0] - hits[j][2] <= self.max_gap]
                best, came = length, -1
                for j in open_:
                    s, a, n = hits[j]
                    over = max(0, s + n - start, a + n - at)
                    if over < length and start + over - s - n <= self.max_gap and at + over - a - n <= self.max_gap and cover[j] + length - over > best:
                        best, came = cover[j] + length - over, j
                cover.append(best)
                own = any(at <= lo and hi <= at + length for lo, hi in self.telling[number])
                tells.append(own or (came >= 0 and tells[came]))
                origin.append(start if came < 0 else origin[came])
                open_.append(k)
            taken: list[tuple[int, int]] = []
            ends = [start + length for start, _, length in hits]
            for k in sorted(range(len(hits)), key=lambda k: (-cover[k], ends[k] - origin[k], origin[k])):
                if cover[k] < self.min_cover * self.sizes[number]:
                    break
                if tells[k] and all(ends[k] <= lo or origin[k] >= hi for lo, hi in taken):
                    taken.append((origin[k], ends[k]))
                    spans.append((number, origin[k], ends[k], min(1.0, cover[k] / self.sizes[number])))
        return sorted(spans)

    def scan(self, text: str) -> tuple[int, int, int | None, int | None, set[str], list[tuple[int, int, int, float]], float]:
        words = words_of(text)
        get = self.ids.get
        ids = np.array([get(w, 0) for w in words], dtype=np.int32)
        starts, labels = self.base(ids)
        spans = self.chains(self.matches(ids)) if len(words) >= self.min_match else []
        score = max([1.0 if starts else 0.0, *(s[3] for s in spans)])
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), labels, spans, score


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Licence labels and template spans of every whole text, without any shuffle.

    Each text streams word by word through the suffix automaton of all templates; what it gives
    are matching statistics (the longest template substring that ends at each word), and from these
    all maximal matches with every place of every template.  Matches of ``min_match`` words and more are chained by
    dynamic programming where text and template both go on within ``max_gap`` words, and a
    chain that covers ``min_cover`` of its template, with words that tell its label from others (see
    :func:`telling_places`), is a span.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans
    (array of label, first, last word and cover).  Words are those of the text with A-Z
    lower-cased.  score is the best cover of a template, 1 where a base phrase stands.

    Null or empty text: no words, no labels, null first and last word, score 0.  Repeated rows are
    each scanned.  Empty table: no rows.  Other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())])
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(span)]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(**options)
        for batch in batches:
            out = []
            for text in batch.column("text"):
                n, n_base, first, last, base, spans, score = scanner.scan(text.as_py())
                labels = base | {scanner.labels[s[0]] for s in spans}
                listed = [{"label": scanner.labels[s[0]], "first": s[1], "last": s[2] - 1, "cover": s[3]} for s in spans]
                out.append((n, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, listed))
            columns = zip(*out, strict=True) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        scan,
        f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,last:bigint,cover:double>>",
    )
