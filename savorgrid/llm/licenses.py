"""License scan: MinHash bands over text windows, exact containment after (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .textcore import LOWER, PrefixHash, chunks, mix, word_spans

SHINGLE = 5
BANDS = 48
SHORT = 4  # templates of so few shingles are matched whole
CHUNK = 1 << 20  # bytes of text worked on at a time
NONE = np.iinfo(np.uint64).max  # minimum of no shingles

#: Notices as their licenses word them.
TEMPLATES: dict[str, str] = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def shingles(words: list[bytes]) -> list[bytes]:
    return [b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def _words(text: str) -> list[bytes]:
    return text.encode().translate(bytes(LOWER)).split()


@dataclass
class TemplateIndex:
    """Templates by class. Of class c <= SHORT: exactly c shingles, matched by windows of c at every place.
    Of a longer class c (a power of two): up to c shingles, more than c / 2; windows of 1.5 c shingles every
    c / 2, so that any stretch of c shingles lies in one.

    With one row a band, a pair of Jaccard similarity s collides with probability 1 - (1 - s) ** bands. A
    window that contains ``threshold`` of a template has s of 0.25 at least, so 48 bands of one row find
    it with probability above 0.999998; a short template and its window are equal sets and always collide.
    """

    templates: dict[str, str]
    threshold: float = 0.8
    bands: int = BANDS
    sets: dict[str, set[bytes]] = field(default_factory=dict)
    classes: dict[int, list[str]] = field(default_factory=dict)

    def __post_init__(self):
        self.factors = np.random.default_rng(11).integers(1, 1 << 63, self.bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for name, text in self.templates.items():
            own = set(shingles(_words(text)))
            if not own:
                raise ValueError(f"template {name} has under {SHINGLE} words")
            self.sets[name] = own
            c = len(own) if len(own) <= SHORT else max(8, 1 << (len(own) - 1).bit_length())
            self.classes.setdefault(c, []).append(name)
        #: class -> band -> (sorted minimum hashes, the template of each)
        self.values: dict[int, list[tuple[np.ndarray, list[list[str]]]]] = {}
        self.marks: dict[int, np.ndarray] = {}
        for c, names in self.classes.items():
            self.marks[c] = np.zeros((self.bands, 1 << 16), dtype=bool)
            found: list[dict[int, list[str]]] = [{} for _ in range(self.bands)]
            for name in names:
                for k, v in enumerate(self.signature(self.hashes(sorted(self.sets[name])))):
                    found[k].setdefault(int(v), []).append(name)
                    self.marks[c][k, int(v) >> 48] = True
            self.values[c] = found

    def hashes(self, own: list[bytes]) -> np.ndarray:
        """Hashes of shingles as ``shingle_hashes`` gives them for a text."""
        out = []
        for s in own:
            buf = np.frombuffer(s, np.uint8)
            starts, ends, _ = word_spans(buf, np.array([0, len(buf)]))
            out.append(shingle_hashes(PrefixHash(buf).spans(starts, ends))[0])
        return np.array(out, dtype=np.uint64)

    def signature(self, h: np.ndarray) -> np.ndarray:
        return np.array([(h * f).min() for f in self.factors], dtype=np.uint64)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    n = max(0, len(words) - SHINGLE + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return mix(out)


def text_shingles(words: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text of a chunk, one text after another, and where each text's begin."""
    counts = np.maximum(0, np.diff(word_at) - (SHINGLE - 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    if not at[-1]:
        return np.zeros(0, dtype=np.uint64), at
    return shingle_hashes(words)[np.arange(at[-1]) + np.repeat(word_at[:-1] - at[:-1], counts)], at


def windows_of(n: int, c: int) -> list[tuple[int, int]]:
    """First shingle and end of each window over ``n`` shingles, for templates of class ``c``."""
    if c <= SHORT:
        return [(i, i + c) for i in range(n - c + 1)]
    half = c // 2
    return [(i, min(n, i + 3 * half)) for i in range(0, max(1, n - half), half)] if n else []


def _groups(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts runs of the given sizes, which lie one after another, into groups of ``width`` that never cross
    runs: where each group starts, and the number of groups before each run."""
    counts = -(-sizes // width)
    before = np.concatenate([[0], np.cumsum(counts)])
    starts = (np.arange(before[-1]) - np.repeat(before[:-1], counts)) * width
    return starts + np.repeat(np.cumsum(sizes) - sizes, counts), before


def _window_minima(index: TemplateIndex, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(class, band, minimum of each window, where each text's windows begin) over all texts of a chunk."""
    sizes = np.diff(at)
    for c in (c for c in index.classes if c <= SHORT):
        x = h * index.factors[0]  # equal sets have equal minima, one band is enough
        n = max(0, len(x) - c + 1)
        low = x[:n].copy()
        for k in range(1, c):
            np.minimum(low, x[k : k + n], out=low)
        counts = np.maximum(0, sizes - c + 1)
        begin = np.concatenate([[0], np.cumsum(counts)])
        yield c, 0, low[np.arange(begin[-1]) + np.repeat(at[:-1] - begin[:-1], counts)], begin
    long = [c for c in index.classes if c > SHORT]
    if not long or not len(h):
        return
    fours, four_at = _groups(sizes, 4)
    halves = {c: _groups(np.diff(four_at), c // 8) for c in long}
    tails = {}
    for c in long:  # a window is up to three halves of its own text
        begin = halves[c][1]
        left = np.repeat(begin[1:], np.diff(begin)) - np.arange(begin[-1])
        # the last half of a text starts no window unless it is the text's only one
        counts = np.where(sizes > 0, np.maximum(1, -(-(sizes - c // 2) // (c // 2))), 0)
        first = np.concatenate([[0], np.cumsum(counts)])
        tails[c] = left < 2, left < 3, np.arange(first[-1]) + np.repeat(begin[:-1] - first[:-1], counts), first
    for k, factor in enumerate(index.factors):
        low = np.minimum.reduceat(h * factor, fours)
        for c in long:
            alone, pair, windows, first = tails[c]
            m = np.minimum.reduceat(low, halves[c][0]) if c > 8 else low
            pad = np.concatenate([m, np.full(2, NONE)])
            second, third = pad[1:-1].copy(), pad[2:].copy()
            second[alone] = NONE
            third[pair] = NONE
            yield c, k, np.minimum(np.minimum(m, second), third)[windows], first


def candidates(index: TemplateIndex, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, str]]:
    """(text number, class, window number, template) of all windows that share a band with a template."""
    out: set[tuple[int, int, int, str]] = set()
    for c, k, low, begin in _window_minima(index, h, at):
        for i in np.flatnonzero(index.marks[c][k].take((low >> np.uint64(48)).astype(np.int64))):
            for name in index.values[c][k].get(int(low[i]), ()):
                text = int(np.searchsorted(begin, i, "right")) - 1
                out.add((text, c, int(i - begin[text]), name))
    return sorted(out)


def verify(index: TemplateIndex, words: list[bytes], c: int, window: int, name: str) -> tuple[float, int] | None:
    """Share of the template's shingles in a window and the first of them, if the share is enough."""
    n = len(words) - SHINGLE + 1
    first, end = (window, window + c) if c <= SHORT else (window * (c // 2), min(n, window * (c // 2) + 3 * (c // 2)))
    inside = shingles(words[first : end + SHINGLE - 1])
    own = index.sets[name]
    share = len(own.intersection(inside)) / len(own)
    return (share, first + next(k for k, s in enumerate(inside) if s in own)) if share >= index.threshold else None


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """A row for each document and template it contains: the other columns, license, containment (the best
    share of the template's five-word shingles in one window) and first_word (where that match starts).

    One narrow pass: the templates' index travels with the function, its size is the templates'. Words are
    lower-cased in A-Z. Null, empty and texts under five words give no rows, nor does an empty table;
    repeated rows are scanned each. Of equally good windows the first counts. Columns called like the
    added ones are replaced. ``carry``: columns to bring along, all but the text by default.
    """
    added = [StructField("license", StringType()), StructField("containment", DoubleType()), StructField("first_word", LongType())]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (text_col, *[f.name for f in added])]
    index = TemplateIndex(templates if templates is not None else TEMPLATES, threshold)
    picked = docs.select(*carry, F.col(text_col).alias("__text"))
    width = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            found: list[tuple[str, float, int]] = []
            for first, last, buf, off in chunks(batch.column(width), CHUNK):
                buf = LOWER[buf]
                starts, ends, word_at = word_spans(buf, off)
                h, at = text_shingles(PrefixHash(buf).spans(starts, ends), word_at)
                raw = buf.tobytes()
                best: dict[tuple[int, str], tuple[float, int]] = {}
                for i, own in groupby(candidates(index, h, at), itemgetter(0)):
                    words = raw[off[i] : off[i + 1]].split()
                    for _, c, window, name in own:
                        hit = verify(index, words, c, window, name)
                        if hit and hit[0] > best.get((i, name), (0.0, 0))[0]:
                            best[i, name] = hit
                for (i, name), hit in sorted(best.items()):
                    rows.append(first + i)
                    found.append((name, *hit))
            names, shares, places = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*[c.take(pa.array(rows, pa.int64())) for c in batch.columns[:width]], pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(places, pa.int64())],
                names=[*carry, *[f.name for f in added]],
            )

    return picked.mapInArrow(run, StructType([*docs.select(*carry).schema.fields, *added]))
