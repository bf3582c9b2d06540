"""License scans: winnowed fingerprints in an inverted index, then alignment in a band as wide as the scores permit."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of

# Opening or defining passages of public licences and notices.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "Rights": "All rights reserved.",
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

#: Words of short templates that tell one licence from another: no match is one without them.
NAMED = {
    "Apache-2.0-line": "Apache 2 0",
    "MIT-line": "MIT",
    "GPL-3.0-line": "GNU General Public 3",
    "CC-BY-NC-4.0-line": "CC BY NC 4 0",
    "SPDX-MIT": "MIT",
    "SPDX-Apache-2.0": "Apache 2 0",
    "CC-BY": "Creative Commons Attribution 4 0",
}

#: Words a fingerprint covers and fingerprints a window covers: any shared run of K + WINDOW - 1 words meets in the index.
K, WINDOW = 2, 2
#: What a match, a mismatch and a gap score.
MATCH, MISMATCH, GAP = 2, -2, -2
#: Words of all templates at most: what is sent to every executor is bounded.
MOST_WORDS = 5_000_000
#: Least share of a template's words that an alignment must match to be reported.
COVERAGE = 0.75

WORD = re.compile(r"[^\W_]+")


class Hashes(dict):
    """Number of a word in small letters; emptied at a size, which bounds memory only."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        data = word.lower().encode("utf-8", "surrogatepass")
        self[word] = got = zlib.crc32(data) << 31 ^ zlib.adler32(data)
        return got


def grams(words: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of every k words in a row; of all words where there are fewer."""
    words = words.astype(np.uint64)
    k = max(1, min(k, len(words)))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = (out ^ words[i : len(words) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the fingerprints: of each window the last of the smallest hashes."""
    picked = np.zeros(len(hashes), bool)
    if len(hashes) <= window:
        picked[len(hashes) - 1 - int(np.argmin(hashes[::-1])) if len(hashes) else []] = True
        return np.flatnonzero(picked)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    picked[np.arange(len(views)) + window - 1 - np.argmin(views, 1)] = True
    return np.flatnonzero(picked)


def index(templates: Mapping[str, str]) -> tuple[dict[str, np.ndarray], dict[int, list[tuple[str, int]]]]:
    """The templates' word hashes, and for each fingerprint the templates and places that have it.

    Templates are winnowed like texts: a run of K + WINDOW - 1 words that both
    have is a window of both, of which both keep the same fingerprint.
    """
    memo, words, posts = Hashes(), {}, defaultdict(list)
    for name, text in templates.items():
        words[name] = np.array([memo[w] for w in WORD.findall(text)], np.int64)
        hashes = grams(words[name]) if len(words[name]) else words[name]
        for place in winnow(hashes).tolist():
            posts[int(hashes[place])].append((name, place))
    return words, dict(posts)


class Template:
    """A template's word hashes and what ``next_match`` needs of them.

    A cell of the alignment is one integer: score, matched words, matched words
    that ``named`` asks for, and the first text word, from the highest bits.
    """

    def __init__(self, words: np.ndarray, coverage: float, named: frozenset[int] = frozenset()):
        n = len(words)
        bits = n.bit_length() + 1
        self.words, self.n, self.need = words, n, max(1, int(np.ceil(coverage * n - 1e-9)))
        self.keys = sum(w in named for w in words.tolist())
        key_bits = self.keys.bit_length()
        self.score_at = 62 - bits - 1
        self.matched_at = self.score_at - bits
        self.keys_at = self.matched_at - key_bits
        self.start_mask, self.keys_mask, self.matched_mask = (1 << self.keys_at) - 1, (1 << key_bits) - 1, (1 << bits) - 1
        self.one, self.gap = 1 << self.score_at, -GAP << self.score_at
        self.other = np.full(n, MISMATCH * self.one, np.int64)
        self.steps = {}
        for w in set(words.tolist()):
            step = (MATCH << self.score_at) + (1 << self.matched_at) + ((w in named) << self.keys_at)
            self.steps[w] = np.where(words == w, step, self.other)
        self.slope = self.gap * np.arange(n, dtype=np.int64)
        self.rest = MATCH * np.arange(n - 1, -1, -1, dtype=np.int64)


def prepared(words: Mapping[str, np.ndarray], coverage: float = COVERAGE, named: Mapping[str, str] | None = None) -> dict[str, Template]:
    memo, named = Hashes(), named or {}
    return {name: Template(w, coverage, frozenset(memo[x] for x in WORD.findall(named.get(name, "")))) for name, w in words.items() if len(w)}


def next_match(template: Template, text: list[int], low: int, high: int) -> tuple[int, int, int] | None:
    """(matched words, first text word, last + 1) of the first match in text words low to high, or None.

    Cells of all template words are kept for each text word, so that words may
    be left out or put in anywhere as far as the score stays positive. A match
    is a cell that matches ``need`` words and the named ones; the best score
    counts among those that overlap, which ends where no alignment that began
    before the match's end can exceed it.
    """
    t = template
    cells, moved, best = np.zeros(t.n, np.int64), np.empty(t.n, np.int64), None
    reached = 0
    for j in range(low, high):
        step = t.steps.get(text[j])
        reached += step is not None
        moved[0] = j - low
        moved[1:] = np.where(cells[:-1] > 0, cells[:-1], j - low)
        moved += t.other if step is None else step
        np.maximum(moved, cells - t.gap, out=moved)
        cells = np.maximum.accumulate(moved + t.slope) - t.slope
        cells[cells < t.one] = 0
        if reached < t.need:
            continue
        ok = (cells >> t.matched_at & t.matched_mask) >= t.need
        if t.keys:
            ok &= (cells >> t.keys_at & t.keys_mask) == t.keys
        if ok.any():
            cell = int(cells[ok].max())
            if best is None or cell >> t.score_at > best[0]:
                best = (cell >> t.score_at, cell >> t.matched_at & t.matched_mask, low + (cell & t.start_mask), j + 1)
        if best is not None:
            rival = (cells > 0) & ((cells & t.start_mask) < best[3] - low) & ((cells >> t.score_at) + t.rest > best[0])
            if not rival.any():
                break
    return best and best[1:]


def regions(own: np.ndarray, template: Template) -> list[tuple[int, int]]:
    """Text words (first, last + 1) outside of which no match lies.

    Each word of an alignment that the template has not costs what a shared one
    gains, at least, and the score of every beginning is positive.
    """
    shared = np.isin(own, template.words)
    total = np.concatenate([[0], np.cumsum(np.where(shared, 1, -1))])
    inside = np.concatenate([[False], total[1:] > np.minimum.accumulate(total)[1:], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    count = np.concatenate([[0], np.cumsum(shared)])
    return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if count[b] - count[a] >= template.need]


def matches(text: str, templates: Mapping[str, Template], posts: Mapping[int, list], sorted_posts: np.ndarray, memo: Hashes) -> list[tuple[str, float, int, int]]:
    """(template, coverage, first character, last + 1) of each match in a text, by place; matches of one template do not overlap."""
    found = WORD.findall(text)
    if not found or not len(sorted_posts):
        return []
    own = np.array(list(map(memo.__getitem__, found)), np.int64)
    hashes = grams(own)
    at = winnow(hashes)
    picked = hashes[at]
    places = at[sorted_posts[np.searchsorted(sorted_posts, picked).clip(max=len(sorted_posts) - 1)] == picked]
    if not len(places):
        return []
    spans, out, words = None, [], None
    for name in {name: None for j in places.tolist() for name, _ in posts[int(hashes[j])]}:
        template = templates[name]
        for low, high in regions(own, template):
            if np.searchsorted(places, low) == np.searchsorted(places, high):
                continue
            words = words or own.tolist()
            while got := next_match(template, words, low, high):
                matched, a, low = got
                spans = spans or [m.span() for m in WORD.finditer(text)]
                out.append((name, matched / template.n, spans[a][0], spans[low - 1][1]))
    return sorted(out, key=lambda x: (x[2], x[3], x[0]))


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_matches and matches (template, coverage, start, end in characters) of every whole text.

    The repository's own short templates match only with the words that NAMED
    asks for. Words are compared in small letters, marks and white space do not count.
    Null counts as the empty text, which has no matches; repeated rows get the
    same matches; other columns are not read; an empty table gives no rows. The
    index holds the templates only, MOST_WORDS words at most (else ValueError).
    """
    words, posts = index(TEMPLATES if templates is None else templates)
    if sum(map(len, words.values())) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words")
    shared = docs.sparkSession.sparkContext.broadcast((prepared(words, coverage, NAMED if templates is None else None), posts, np.array(sorted(posts), np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, posts, known = shared.value
        memo = Hashes()
        kind = pa.list_(pa.struct([("template", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            got = [matches(t, ready, posts, known, memo) for t in b.column("text").to_pylist()]
            rows = pa.array([[dict(zip(("template", "coverage", "start", "end"), m, strict=True)) for m in g] for g in got], kind)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(g) for g in got], pa.int64()), rows], names=["doc_id", "n_matches", "matches"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_matches long, matches array<struct<template:string,coverage:double,start:long,end:long>>")


def templates_from(spark: SparkSession, path: str) -> dict[str, str]:
    """Whole licence texts of a folder, one file each, by file name: templates for ``scan``."""
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    return {r.name: r.value for r in rows.collect()}


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = F.transform("matches", lambda m: F.concat_ws(":", m["template"], F.format_number(m["coverage"], 4), m["start"], m["end"]))
    return scan(documents(spark, sf_dir)).select("doc_id", "n_matches", F.array_join(spelled, ",").alias("spans"))
