"""Operator 6: license scans by winnowed fingerprints and banded alignment.

Templates are words; their GRAM-word shingles are hashed, and of each WINDOW neighbours the least is a fingerprint. An
inverted index from fingerprints to places in templates names starts: a shingle of a text that is in the index says
which template may stand there, and from which word on. Edits can hit every fingerprint, so for each start it is also
counted how many of a template's words stand inside a band of diagonals around it; where these are too few for the
coverage no alignment can reach it, and all other starts are candidates, those of fingerprints first. Each candidate is
aligned with its template inside the band; matched words over the template's words are the coverage, and the first and
last matched word the span, in characters of the text. Matches of coverage MIN_COVERAGE and more are reported.

Words are runs of letters and digits, compared in lower case. One pass over the documents, without a shuffle; the index
is as large as the templates, which are a parameter.

Defined results: null texts and texts without words give no row; a text that holds a template several times gives a row
for each place that doesn't overlap a better one of the same template (ties: the shorter span, then the first);
templates match independently of each other; repeated rows give repeated results; extra columns aren't carried.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import prepare, table

GRAM, WINDOW = 3, 4
MIN_COVERAGE = 0.8
WORD = re.compile(r"[^\W_]+")

#: Names and wordings of license notices.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT line": "Released under the MIT License.",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations
        under the License.""",
    "GPL-3.0 notice": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        GNU General Public License for more details.""",
    "MIT notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the Software.""",
    "CC-BY-4.0 notice": """This work is licensed under the Creative Commons Attribution 4.0 International License. To
        view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative
        Commons, PO Box 1866, Mountain View, CA 94042, USA.""",
}


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.lower().encode()) - (1 << 63)
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = _Hashes()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.int64, len(words))


def grams(hashes: np.ndarray) -> np.ndarray:
    """Hashes of GRAM neighbouring words."""
    n = len(hashes) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = hashes.view(np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for i in range(1, GRAM):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : n + i]
        return (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def band_of(size: int) -> int:
    """Diagonals to each side of a start that a template of so many words may use."""
    return max(2, size // 8)


def winnow(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of each window's least hash, the last of equals; all in one window where there are fewer."""
    n = len(hashes)
    places = set()
    for a in range(max(1, n - window + 1)):
        part = hashes[a : a + window]
        if len(part):
            places.add(a + len(part) - 1 - int(part[::-1].argmin()))
    return sorted(places)


class Index:
    def __init__(self, templates: dict[str, str]):
        self.words: list[np.ndarray] = []
        self.names: list[str] = []
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for name, text in templates.items():
            own = word_hashes(WORD.findall(text))
            if len(own) < GRAM:
                raise ValueError(f"template {name!r} has under {GRAM} words")
            found = grams(own)
            for p in winnow(found):
                postings[int(found[p])].append((len(self.names), p))
            self.names.append(name)
            self.words.append(own)
        self.keys = np.array(sorted(postings), np.uint64)
        self.postings = [postings[int(k)] for k in self.keys]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.bands = np.array([band_of(int(n)) for n in self.sizes], np.int64)
        #: Of each word of each template, in their order: the template and the word's place; and by distinct words
        self.template = np.repeat(np.arange(len(self.words)), self.sizes)
        self.place = np.concatenate([np.arange(n) for n in self.sizes])
        flat = np.concatenate(self.words)
        self.spots = np.argsort(flat, kind="stable")
        self.vocabulary, self.degree = np.unique(flat, return_counts=True)
        self.begin = np.cumsum(self.degree) - self.degree

    def candidates(self, hashes: np.ndarray) -> dict[int, list[int]]:
        """For each template the word places at which it may begin, by fingerprints."""
        found = grams(hashes)
        at = np.searchsorted(self.keys, found)
        at[at == len(self.keys)] = 0
        starts: dict[int, set[int]] = defaultdict(set)
        for place in np.flatnonzero(self.keys[at] == found).tolist():
            for template, p in self.postings[at[place]]:
                starts[template].add(place - p)
        return {t: sorted(s) for t, s in starts.items()}

    def supported(self, hashes: np.ndarray, coverage: float) -> dict[int, dict[int, int]]:
        """For each template the starts that have enough of its words inside their bands, and how many these are."""
        n = len(hashes)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        known = np.flatnonzero(self.vocabulary[at] == hashes)
        if not len(known):
            return {}
        at = at[known]
        degree = self.degree[at]
        shift = np.arange(degree.sum()) - np.repeat(np.cumsum(degree) - degree, degree)
        hits = np.sort(self.spots[np.repeat(self.begin[at], degree) + shift] * n + np.repeat(known, degree))
        spot, place = np.divmod(hits, n)
        template = self.template[spot]
        band, diagonal = self.bands[template], place - self.place[spot]
        # the starts whose bands hold a hit, those of a word's neighbouring hits once
        low, high = diagonal - band, diagonal + band + 1
        low[1:] = np.where(spot[1:] == spot[:-1], np.maximum(low[1:], high[:-1]), low[1:])
        pad = int((self.sizes + self.bands).max()) + 1
        width = n + 2 * pad
        base, cells = template * width + pad, len(self.words) * width
        counts = np.cumsum(np.bincount(base + low, minlength=cells) - np.bincount(base + high, minlength=cells)).reshape(-1, width)
        out: dict[int, dict[int, int]] = defaultdict(dict)
        for t, s in np.argwhere((counts >= coverage * self.sizes[:, None]) & (counts > 0)).tolist():
            out[t][s - pad] = int(counts[t, s])
        return out


def align(template: list[int], words: list[int], start: int, band: int) -> tuple[int, int, int]:
    """Most words matched in order on diagonals start - band .. start + band; the first and last matched word's place."""
    width = 2 * band + 1
    none = (0, 0, 0)  # matches, minus first place, minus last place: more matches first, then the shorter span
    row = [none] * (width + 1)
    for i, w in enumerate(template):
        new = [none] * (width + 1)
        for d in range(width):
            j = start + i + d - band
            best = max(row[d + 1] if d + 1 < width else none, new[d - 1] if d else none, row[d], key=lambda x: (x[0], x[1] - x[2]))
            if 0 <= j < len(words) and words[j] == w:
                m, first, _ = row[d]
                hit = (m + 1, first if m else j, j)
                if (hit[0], hit[1] - hit[2]) >= (best[0], best[1] - best[2]):
                    best = hit
            new[d] = best
        row = new
    return max(row, key=lambda x: (x[0], x[1] - x[2]))


def matches(text: str | None, index: Index, coverage: float = MIN_COVERAGE) -> list[tuple[str, int, int, int, int]]:
    """(template, matched words, template's words, first character, character after the last) of each match."""
    if not text:
        return []
    hashes = word_hashes(WORD.findall(text))
    found = []
    supported = index.supported(hashes, coverage)
    named = index.candidates(hashes) if supported else {}
    for t, support in supported.items():
        own = index.words[t].tolist()
        band = band_of(len(own))
        # in a long template, matches from starts within a band of each other overlap, so only a better one counts
        overlap = (2 * coverage - 1) * len(own) > 4 * band + 2
        fingerprints = set(named.get(t, ()))
        aligned = []
        done: list[tuple[int, int]] = []
        for s in sorted(support, key=lambda s: (s not in fingerprints, -support[s], s)):
            if overlap and any(abs(s - x) <= band and m >= support[s] for x, m in done):
                continue
            best = align(own, hashes[max(0, s - band) : max(0, s + len(own) + band)].tolist(), s - max(0, s - band), band)
            if best[0] >= coverage * len(own):
                aligned.append(best + (max(0, s - band),))
                done.append((s, best[0]))
        taken: list[tuple[int, int]] = []
        for m, first, last, base in sorted(aligned, key=lambda x: (-x[0], x[2] - x[1], x[3] + x[1])):
            a, b = base + first, base + last
            if all(b < x or a > y for x, y in taken):
                taken.append((a, b))
                found.append((index.names[t], m, len(own), a, b))
    if not found:
        return []
    spans = [x.span() for x in WORD.finditer(text)]
    return sorted(((n, m, k, spans[a][0], spans[b][1]) for n, m, k, a, b in found), key=lambda x: (x[3], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = MIN_COVERAGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each match: doc_id, license, matched_words, template_words, start, end."""
    wordings = TEMPLATES if templates is None else templates
    schema = "doc_id long, license string, matched_words long, template_words long, start long, end long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(wordings)
        for batch in batches:
            rows = [(k, *m) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in matches(t, index, coverage)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].cast("string").alias("t")).mapInArrow(run, schema)


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every whole text of `documents`."""
    prepare(spark)
    found = scan(table(spark, sf_dir, "documents"))
    return found.withColumn("coverage", F.round(F.col("matched_words") / F.col("template_words"), 4))


ORACLES: dict[str, str] = {}
QUERIES = {"op6_license_scan": license_scan}
