"""License scans by winnowed fingerprints and banded alignment.

The templates' word n-grams are hashed and winnowed (of each window of hashes the least
is kept) into an inverted index hash -> (template, place). A text's n-grams are looked up
in the index; hits whose diagonals lie close together are one candidate place of a template. There the
words are aligned with the template in a band around the diagonal, which
gives the matched words, their share of the template (coverage) and their span. Hits that
are in no place found so are chained across diagonals, in the order of text and template, and aligned in a band that holds
all diagonals of the chain; so any number of words may be left out, and up to as many as the template has be put in at one point.

The templates are short and of fixed number, so their index goes to every task.
Every n-gram of the text is looked up, so any template passage of ``NGRAM + WINNOW - 1`` words
that a text holds unchanged is found.

Defined cases: null and empty texts hold no license; places of one template that
overlap are one, the best aligned; each other repetition is a row; a repeated row
repeats its rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

NGRAM, WINNOW, COVERAGE = 3, 2, 0.8
#: Diagonals on either side in an alignment: half the template's words, within these bounds.
BAND = (2, 12)

# The texts of public licenses' notices.
TEMPLATES: dict[str, str] = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

_SPLIT = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_SPLIT).split()


def _gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for k in range(n):
        out += ids[k : k + len(out)] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
    return out ^ (out >> np.uint64(31))


def winnow(hashes: np.ndarray, window: int) -> list[int]:
    """Places of the rightmost least hash of each window."""
    if len(hashes) <= window:
        return [int(len(hashes) - 1 - hashes[::-1].argmin())] if len(hashes) else []
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return sorted(set((np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(1)).tolist()))


class Scanner:
    def __init__(self, templates: dict[str, str], n: int = NGRAM, window: int = WINNOW, coverage: float = COVERAGE, band: tuple[int, int] = BAND):
        self.n, self.coverage = n, coverage
        self.names = sorted(templates)
        self.words = [words(templates[k]) for k in self.names]
        self.bands = [min(max(len(t) // 2, band[0]), band[1]) for t in self.words]
        self.vocabulary = {w: np.uint64(xxhash.xxh64_intdigest(w)) for t in self.words for w in t}
        self.index: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.words):
            h = _gram_hashes(np.array([self.vocabulary[w] for w in t], np.uint64), n)
            for place in winnow(h, window):
                self.index.setdefault(int(h[place]), []).append((k, place))
        self.hashes = np.array(sorted(self.index), np.uint64)

    def hits(self, text: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, word of the text, word of the template) of the fingerprints found, in the order of the text."""
        known = self.vocabulary.get
        none = np.uint64(0)
        ids = np.fromiter((known(w, none) for w in text), np.uint64, len(text))
        live = np.flatnonzero(ids)
        if len(live) < self.n:
            return []
        h = _gram_hashes(ids, self.n)
        solid = ids[: len(h)] != 0
        for k in range(1, self.n):
            solid &= ids[k : k + len(h)] != 0
        at = np.flatnonzero(solid)
        at = at[np.isin(h[at], self.hashes)]
        return [(k, p, place) for p in at.tolist() for k, place in self.index[int(h[p])]]

    def chained(self, k: int, hits: list[tuple[int, int]], text: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """Alignments of template ``k`` along chains of hits (word of the text, of the template) over several diagonals."""
        template = self.words[k]
        size, least = len(template), self.coverage * len(template)
        for chain in chains(hits, size):
            diagonals = [p - t for p, t in chain]
            lo, hi = min(diagonals), max(diagonals)
            if lo == hi:
                continue
            margin = self.bands[k]
            window = Counter(text[max(0, chain[0][0] - size - margin) : chain[-1][0] + size + margin])
            if sum(min(n, window[w]) for w, n in Counter(template).items()) >= least:
                matched, a, b = align(template, text, (lo + hi) // 2, (hi - lo + 1) // 2 + margin)
                if matched >= least:
                    yield matched, a, b

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched words, start, end) of each place, in characters of the text."""
        if not text:
            return []
        w = words(text)
        found = []
        last: dict[int, int] = {}
        hits = self.hits(w)
        for k, diagonal in sorted({(k, p - place) for k, p, place in hits}):
            if k in last and diagonal - last[k] <= self.bands[k]:
                continue  # the same place, some words inserted or left out
            last[k] = diagonal
            matched, a, b = align(self.words[k], w, diagonal, self.bands[k])
            if matched and matched / len(self.words[k]) >= self.coverage:
                found.append((matched / len(self.words[k]), matched, k, a, b))
        out, taken = [], []

        def take(found: list[tuple]) -> None:
            for cov, matched, k, a, b in sorted(found, key=lambda x: (x[2], -x[0], x[3])):
                if not any(j == k and a <= d and c <= b for j, c, d in taken):
                    taken.append((k, a, b))
                    out.append((k, cov, matched, a, b))

        take(found)
        left: dict[int, list[tuple[int, int]]] = {}
        for k, p, place in hits:
            if not any(j == k and a < p + self.n and p <= b for j, a, b in taken):
                left.setdefault(k, []).append((p, place))
        take([(matched / len(self.words[k]), matched, k, a, b) for k, some in left.items() for matched, a, b in self.chained(k, some, w)])
        if not out:
            return []
        spans = _word_spans(text, w)
        return [(self.names[k], cov, matched, spans[a][0], spans[b][1]) for k, cov, matched, a, b in sorted(out, key=lambda x: (x[3], x[0]))]


def _word_spans(text: str, w: list[bytes]) -> list[tuple[int, int]]:
    """Character span of each word."""
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    assert len(spans) == len(w)
    return spans


def chains(hits: list[tuple[int, int]], longest: int) -> Iterator[list[tuple[int, int]]]:
    """Hits in rising order of both places, at most ``longest`` words put in between two of them; the chain of most hits first, each hit in one chain."""
    p, t = np.array(sorted(hits), np.int64).T
    number, shift, before = np.ones(len(p), np.int64), np.zeros(len(p), np.int64), np.full(len(p), -1)
    for i in range(1, len(p)):
        lo = int(np.searchsorted(p, p[i] - 2 * longest))
        step = (p[i] - p[lo:i]) - (t[i] - t[lo:i])
        ok = np.flatnonzero((p[lo:i] < p[i]) & (t[lo:i] < t[i]) & (step <= longest))
        if len(ok):
            # Most hits, then the least change of diagonals.
            moved = shift[lo + ok] + np.abs(step[ok])
            best = np.lexsort((moved, -number[lo + ok]))[0]
            before[i], number[i], shift[i] = lo + ok[best], number[lo + ok[best]] + 1, moved[best]
    used = np.zeros(len(p), bool)
    for i in np.lexsort((shift, -number)).tolist():
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append((int(p[i]), int(t[i])))
            i = int(before[i])
        if len(chain) > 1:
            yield chain[::-1]


def align(template: list[bytes], text: list[bytes], diagonal: int, band: int) -> tuple[int, int, int]:
    """Longest common subsequence of the template and the text within a band of diagonals: (matched words, first, last text word)."""
    lo = diagonal - band
    width = 2 * band + 1
    score = [(0, 0, -1, -1)] * (width + 1)  # matched, minus text words passed over between matches, first, last; cell j is text word i + lo + j
    for i, word in enumerate(template):
        row = [(0, 0, -1, -1)] * (width + 1)
        for j in range(width):
            at = i + lo + j
            best = max(score[j + 1], row[j - 1] if j else (0, 0, -1, -1))
            if 0 <= at < len(text) and text[at] == word:
                m, gap, first, last = score[j]
                best = max(best, (m + 1, gap - (at - last - 1 if last >= 0 else 0), first if first >= 0 else at, at))
            row[j] = best
        score = row
    m, _, first, last = max(score)
    return m, first, last


SPANS = "license string, coverage double, n_matched int, span_start long, span_end long"


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per document and place of a license: id, license, coverage, n_matched, span_start, span_end (characters, end exclusive)."""
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(df.sparkSession)
    kind = df.schema[id_col].dataType
    id_type, used = to_arrow_type(kind), dict(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(used, coverage=coverage)
        for b in batches:
            rows = [(i, *hit) for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True) for hit in scanner.scan(t)]
            if rows:
                cols = zip(*rows, strict=True)
                kinds = (id_type, pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "license", "coverage", "n_matched", "span_start", "span_end"])

    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(run, f"id {kind.simpleString()}, {SPANS}").withColumnRenamed("id", id_col)
