"""License scan with a generalised suffix automaton over the words of license templates.

Texts stream through the automaton of all templates, which yields matching statistics: for every
word the longest run ending there that stands in some template. Long maximal runs are placed in
their templates and chained, in order on both sides, into spans; a span that covers enough of a
template names its license. Of a template's chains, those are listed that don't overlap and cover most together. All of it is one pass from left to
right, so that a file that repeats a notice costs in proportion to its length. Phrases that name a license outright are looked for beside it, and
their labels stay. Templates are a parameter: ``TEMPLATES`` holds short licenses and notices, ``read_templates`` reads whole texts.

Defined results: a null text counts as empty; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A
to Z; repeated rows are scanned each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.llm.frames import slices, text_bytes
from quantloom.llm.words import LOWER, NOT_ALNUM, hash_spans, hash_words, split_words

# The phrases that name a license, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
)
_BSD_BINARY = (
    " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
_BSD_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
    "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the Software."
)

# Well-known license texts and notices, as published.
TEMPLATES = {
    "mit": [
        _MIT,
        _MIT + " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
    ],
    "bsd": [_BSD],
    "bsd-2-clause": [_BSD + _BSD_BINARY + _BSD_DISCLAIMER],
    "bsd-3-clause": [_BSD + _BSD_BINARY + _BSD_NAMES + _BSD_DISCLAIMER],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "gpl-2": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "gpl-3": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "cc-by-nc": [
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
}
#: Bytes of templates that are sent to every task, at most; more are refused.
MOST_TEMPLATE_BYTES = 16 << 20
#: Words of a run that is worth placing, words that a span may skip between runs, and the share of a
#: template that its span has to cover.
LEAST_RUN = 4
MOST_GAP = 12
LEAST_COVER = 0.6


def tokens(text: str) -> np.ndarray:
    """Word hashes of a text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return hash_words(LOWER[raw], np.array([0, len(raw)]), NOT_ALNUM)[0]


class SuffixAutomaton:
    """A generalised suffix automaton; each state knows an occurrence (template, end) of its strings."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.where: list[set[tuple[int, int]]] = [set()]
        ends: list[tuple[int, int, int]] = []
        for t, words in enumerate(templates):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                ends.append((last, t, i))
        for state, t, i in ends:  # every end of a template's prefix is one of all its suffixes
            while state > 0 and (t, i) not in self.where[state]:
                self.where[state].add((t, i))
                state = self.link[state]

    def _add(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges), self.link.append(link), self.length.append(length), self.where.append(set())
        return len(self.next) - 1

    def _split(self, state: int, word: int) -> int:
        """The state for ``word`` after ``state``'s longest string, split off if longer strings share it."""
        old = self.next[state][word]
        if self.length[old] == self.length[state] + 1:
            return old
        new = self._add(self.length[state] + 1, self.link[old], dict(self.next[old]))
        self.link[old] = new
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = new
            state = self.link[state]
        return new

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._add(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """(length of the longest match ending at each word, its state)."""
        state, long = 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                long = self.length[state]
            if w in self.next[state]:
                state, long = self.next[state][w], long + 1
            else:
                state, long = 0, 0
            yield long, state

    def runs(self, words: list[int], least: int) -> list[tuple[int, int, int]]:
        """Maximal matches of ``least`` words or more: (start, length, state), from left to right."""
        found, state, long = [], 0, 0
        following, link, length = self.next, self.link, self.length
        for i, w in enumerate(words):
            after = following[state].get(w)
            if after is None:
                if long >= least:
                    found.append((i - long, long, state))
                while state and w not in following[state]:
                    state = link[state]
                    long = length[state]
                after = following[state].get(w)
                if after is None:
                    long = 0
                    continue
            state = after
            long += 1
        if long >= least:
            found.append((len(words) - long, long, state))
        return found


class Scanner:
    """Phrases and templates made ready for scanning."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.names = [name for name, texts in templates.items() for _ in texts]
        coded = [tokens(t) for texts in templates.values() for t in texts]
        self.sizes = [len(c) for c in coded]
        self.automaton = SuffixAutomaton([c.tolist() for c in coded])
        self.vocabulary = np.unique(np.concatenate(coded)) if coded else np.empty(0, np.uint64)
        self.phrases = [(tokens(p), label) for p, label in phrases.items()]

    def spans(self, words: list[int], base: int = 0) -> list[tuple[int, int, int, float]]:
        """(template, first word, end, covered share): the best chain of each template, and all others that cover enough and don't overlap; words are numbered from ``base``."""
        return self.chained(self.automaton.runs(words, LEAST_RUN), base)

    def chained(self, runs: list[tuple[int, int, int]], base: int = 0) -> list[tuple[int, int, int, float]]:
        places: dict[int, list[tuple[int, int, int]]] = {}
        for start, long, state in runs:
            for t, end in self.automaton.where[state]:
                places.setdefault(t, []).append((base + start, end - long + 1, long))
        out = []
        for t, own in places.items():
            own.sort()
            chains = self.chains(t, own)
            enough = [c for c in chains if c[0] >= LEAST_COVER * self.sizes[t]]
            chosen = apart(enough) if enough else [max(chains)[:3]]
            out += [(t, first, end, covered / self.sizes[t]) for covered, first, end in chosen]
        return out

    def chains(self, t: int, own: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """The best chain that ends with each run (place, place in template ``t``, length; sorted): covered words, first word, end, end in the template."""
        chains: list[tuple[int, int, int, int]] = []
        near = 0  # runs before this one end too early to be gone on from
        for start, at, long in own:
            best = (long, start, start + long, at + long)
            while near < len(chains) and chains[near][2] < start - MOST_GAP:
                near += 1
            for covered, first, end, stop in chains[near:]:
                shift = max(0, end - start, stop - at)
                if start + shift - end <= MOST_GAP and at + shift - stop <= MOST_GAP and shift < long:
                    best = max(best, (covered + long - shift, first, start + long, at + long))
            chains.append(best)
        return chains


def apart(chains: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """Of chains (covered, first, end, ...), those that cover most together without overlapping: covered, first, end, from left to right."""
    ordered = sorted({(end, first, covered) for covered, first, end, *_ in chains})
    ends = [x[0] for x in ordered]
    best, take, before = [0], [], []
    for i, (_, first, covered) in enumerate(ordered):
        k = bisect_right(ends, first, 0, i)
        take.append(covered + best[k] > best[i])
        before.append(k)
        best.append(max(best[i], covered + best[k]))
    out, i = [], len(ordered)
    while i:
        if take[i - 1]:
            end, first, covered = ordered[i - 1]
            out.append((covered, first, end))
            i = before[i - 1]
        else:
            i -= 1
    return out[::-1]


_SCANNERS: dict[int, Scanner] = {}


def _scanner(templates: dict[str, list[str]], phrases: dict[str, str]) -> Scanner:
    """The worker's scanner for these templates, built once."""
    key = hash((tuple((n, *t) for n, t in templates.items()), tuple(phrases.items())))
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(templates, phrases)
    return _SCANNERS[key]


def _scan(with_spans: bool, templates: dict[str, list[str]], phrases: dict[str, str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(templates, phrases)
        for batch in batches:
            for piece in slices(batch, "text"):
                data, at = text_bytes(piece.column("text"))
                data = LOWER[data]
                starts, ends, rows = split_words(data, at, NOT_ALNUM)
                words = hash_spans(data, starts, ends)
                n = piece.num_rows
                row_of = np.repeat(np.arange(n), np.diff(rows))
                known = np.isin(words, scanner.vocabulary) if len(words) else np.empty(0, bool)
                count, first, last = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
                labels: list[set[str]] = [set() for _ in range(n)]
                for phrase, label in scanner.phrases:
                    m = len(phrase)
                    hit = np.flatnonzero(words == phrase[0])
                    hit = hit[hit + m <= len(words)]
                    for j in range(1, m):
                        hit = hit[words[hit + j] == phrase[j]]
                    hit = hit[row_of[hit] == row_of[hit + m - 1]]
                    for h in hit.tolist():
                        r = int(row_of[h])
                        place = h - int(rows[r])
                        count[r] += 1
                        first[r] = place if first[r] < 0 else min(first[r], place)
                        last[r] = max(last[r], place)
                        labels[r].add(label)
                base = [",".join(sorted(x)) for x in labels]
                # Only stretches of template words that are long enough go through the automaton, word by word.
                edge = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
                cut = np.unique(np.concatenate((edge, rows[1:-1][known[np.minimum(rows[1:-1], len(known) - 1)]] if len(known) else edge)))
                begins, finish = cut[:-1], cut[1:]
                fit = (finish - begins >= LEAST_RUN) & known[np.minimum(begins, max(len(known) - 1, 0))] if len(known) else np.empty(0, bool)
                score = np.array([1.0 if x else 0.0 for x in labels])
                spans: list[list[dict]] = [[] for _ in range(n)]
                runs: dict[int, list[tuple[int, int, int]]] = {}
                for a, b in zip(begins[fit].tolist(), finish[fit].tolist(), strict=True):
                    r = int(row_of[a])
                    first_word = a - int(rows[r])
                    runs.setdefault(r, []).extend((first_word + start, long, state) for start, long, state in scanner.automaton.runs(words[a:b].tolist(), LEAST_RUN))
                for r, own in runs.items():
                    for t, begin, end, cover in scanner.chained(own):
                        score[r] = max(score[r], min(1.0, cover))
                        if cover >= LEAST_COVER:
                            labels[r].add(scanner.names[t])
                            spans[r].append({"label": scanner.names[t], "first_word": begin, "end_word": end, "cover": cover})
                arrays = [
                    piece.column("doc_id"), pa.array(np.diff(rows)), pa.array(count), pa.array(first, mask=first < 0), pa.array(last, mask=last < 0),
                    pa.array(base), pa.array([",".join(sorted(x)) for x in labels]), pa.array(score),
                ]
                if with_spans:
                    arrays.append(pa.array(spans, pa.list_(pa.struct({"label": pa.string(), "first_word": pa.int64(), "end_word": pa.int64(), "cover": pa.float64()}))))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", *["spans"] * with_spans])

    return scan


def read_templates(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Whole license texts from the text files of ``folder``, which Spark can read: name of the file without its ending -> text."""
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[A-Za-z]+)?$", 1).alias("name"), "value", F.sum(F.octet_length("value")).over(W.partitionBy()).alias("bytes"))
    if (rows.agg(F.max("bytes")).first()[0] or 0) > MOST_TEMPLATE_BYTES:
        raise ValueError(f"license texts of over {MOST_TEMPLATE_BYTES} bytes")
    found: dict[str, list[str]] = {}
    for r in rows.orderBy("name", "value").collect():
        found.setdefault(r["name"], []).append(r["value"])
    return found


def scan_licenses(documents: DataFrame, with_spans: bool = False, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (and spans) of every row (doc_id, text)."""
    if sum(len(t.encode()) for texts in templates.values() for t in texts) > MOST_TEMPLATE_BYTES:
        raise ValueError(f"license texts of over {MOST_TEMPLATE_BYTES} bytes")
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    if with_spans:
        schema += ", spans array<struct<label: string, first_word: long, end_word: long, cover: double>>"
    return documents.select("doc_id", "text").mapInArrow(_scan(with_spans, templates, phrases), schema)
