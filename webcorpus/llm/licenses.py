"""License notices in documents: MinHash bands over overlapping windows, then exact containment.

A template is a set of five-word shingles. Windows of about a template's length slide over a text in
steps of an eighth; a window that shares all minima of a band with a template retrieves it. The
number of bands is derived from the least similarity that a window over a true notice can have, so
that it is retrieved with probability ``RECALL``. The region of a retrieved window is then compared
shingle by shingle and split into occurrences: each that holds ``CONTAINED`` of the template's
shingles is a notice.
"""

from __future__ import annotations

import math
import sys
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.common import plain_words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
CONTAINED = 0.8
ROWS = 2  # minima per band
RECALL = 0.999
PART = 60_000  # words hashed at once; parts of one row overlap by the longest window

# Customary wordings of license notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files, to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
        " copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License"
        " is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or"
        " implied. See the License for the specific language governing permissions and limitations under"
        " the License.",
    ),
    (
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        " General Public License as published by the Free Software Foundation",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted"
        " provided that the following conditions are met",
    ),
)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < size:
        for k, factor in enumerate((_BASE, _BACK)):
            grown = np.full(1 << (size - 1).bit_length(), factor, np.uint64)
            grown[0] = 1
            _POWERS[k] = np.multiply.accumulate(grown)
    return _POWERS[0][:size], _POWERS[1][:size]


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every run of five words, all at once by prefix sums of a polynomial."""
    count = len(words) - SHINGLE + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    forward, back = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * forward[:-1], dtype=np.uint64)])
    x = (sums[ends[SHINGLE - 1 :]] - sums[starts[:count]]) * back[starts[:count]]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def least_similarity(size: int, step: int) -> float:
    """The least Jaccard similarity of a template and the best window over a notice of it."""
    shared = math.ceil(CONTAINED * size) - step // 2
    return max(1, shared) / (2 * size - max(1, shared))


def band_count(size: int, step: int) -> int:
    """Bands for which a window at the least similarity is retrieved with probability RECALL."""
    hit = least_similarity(size, step) ** ROWS
    return 1 if hit >= 1 else math.ceil(math.log(1 - RECALL) / math.log(1 - hit))


def _mixers(count: int) -> list[tuple[np.uint64, np.uint64]]:
    odd = np.random.default_rng(5).integers(1, 2**63, size=(count, 2), dtype=np.uint64) | np.uint64(1)
    return [(a, b) for a, b in odd]


class Scanner:
    """Templates by window size, with the band keys that retrieve them."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> None:
        self.names: list[str] = []
        self.shingles: list[dict[tuple[bytes, ...], list[int]]] = []  # with their places
        by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for name, text in templates:
            words = plain_words(text)
            hashes = shingle_hashes(words)
            if len(hashes):
                by_size[len(hashes)].append((len(self.names), hashes))
                self.names.append(name)
                places: dict[tuple[bytes, ...], list[int]] = defaultdict(list)
                for k, shingle in enumerate(zip(*(words[k:] for k in range(SHINGLE)))):
                    places[shingle].append(k)
                self.shingles.append(dict(places))
        self.classes = []
        for size, own in sorted(by_size.items()):
            step = max(1, size // 8)
            bands = band_count(size, step)
            keys: dict[int, dict[int, list[int]]] = {b: defaultdict(list) for b in range(bands)}
            mixers = _mixers(bands * ROWS)
            for template, hashes in own:
                minima = [np.array([(hashes * a ^ b).min()]) for a, b in mixers]
                for b in range(bands):
                    keys[b][int(_key(minima[b * ROWS : (b + 1) * ROWS])[0])].append(template)
            tables = [(np.array(sorted(keys[b]), np.uint64), [keys[b][k] for k in sorted(keys[b])]) for b in range(bands)]
            self.classes.append((size, step, mixers, tables))
        self.longest = max((size for size, *_ in self.classes), default=0)

    def _retrieved(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, first shingle, last shingle + 1) of the windows that share a band."""
        for size, step, mixers, tables in self.classes:
            if not len(hashes):
                continue
            starts = np.arange(0, max(1, len(hashes) - size + step), step)
            for band, (keys, templates) in enumerate(tables):
                minima = [_window_minima(hashes * a ^ b, size, step, len(starts)) for a, b in mixers[band * ROWS : (band + 1) * ROWS]]
                own = _key(minima)
                place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                for k in np.nonzero(keys[place] == own)[0].tolist():
                    for template in templates[place[k]]:
                        yield template, int(starts[k]), int(starts[k]) + size

    def _windows(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(template, first word, last shingle + 1) of all windows retrieved in a row of words."""
        overlap = 2 * self.longest + SHINGLE
        with np.errstate(over="ignore"):
            for at in range(0, max(1, len(words) - SHINGLE + 1), PART):
                for template, start, end in self._retrieved(shingle_hashes(words[at : at + PART + overlap])):
                    yield template, at + start, at + end

    def find(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, containment, first word, last word) of each notice in a text.

        Of notices that overlap only the best contained one stays, ties to the longer.
        """
        return next(self.find_each([text]))

    def find_each(self, texts: list[str | None]) -> Iterator[list[tuple[str, float, int, int]]]:
        """The notices of each text. Texts are hashed one after the other in rows of many.

        A window may lie over several texts; it proposes its template to each of them, and only
        a text's own words are compared.
        """
        held: list[list[bytes]] = []
        size = 0
        for text in texts:
            held.append(plain_words(text))
            size += len(held[-1])
            if size >= PART:
                yield from self._row(held)
                held, size = [], 0
        yield from self._row(held)

    def _row(self, texts: list[list[bytes]]) -> Iterator[list[tuple[str, float, int, int]]]:
        ends = np.cumsum([len(words) for words in texts])
        windows: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        for template, start, end in self._windows([w for words in texts for w in words]):
            first = int(np.searchsorted(ends, start, side="right"))
            for own in range(first, len(texts)):
                begin = int(ends[own]) - len(texts[own])
                if begin >= end + SHINGLE - 1:
                    break
                windows[own][template].add((start - begin, end - begin))
        for own, words in enumerate(texts):
            yield self._verified(words, windows[own]) if own in windows else []

    def _verified(self, words: list[bytes], windows: dict[int, set[tuple[int, int]]]) -> list[tuple[str, float, int, int]]:
        found = {}
        for template, own in windows.items():
            wanted = self.shingles[template]
            for first, last in _merged(sorted(own), len(wanted)):
                region = words[max(0, first) : max(0, last + SHINGLE - 1)]
                for held, begin, end in _occurrences(zip(*(region[j:] for j in range(SHINGLE))), wanted):
                    key = self.names[template], max(0, first) + begin, max(0, first) + end + SHINGLE - 1
                    found[key] = max(held, found.get(key, 0.0))
        best: list[tuple[str, float, int, int]] = []
        for (name, begin, end), held in sorted(found.items(), key=lambda x: (-x[1], x[0][1] - x[0][2], x[0])):
            if all(end < b or begin > e for _, _, b, e in best):
                best.append((name, held, begin, end))
        return sorted(best)


def _occurrences(shingles: Iterable[tuple[bytes, ...]], wanted: dict[tuple[bytes, ...], list[int]]) -> Iterator[tuple[float, int, int]]:
    """(containment, first shingle, last shingle) of each notice of a template in a region.

    The template's shingles are cut into runs: where they step back in the template, and at long
    gaps. As soon as the runs since the last notice hold enough, the fewest last of them are one.
    """
    need, gap, at = CONTAINED * len(wanted), len(wanted) // 4 + SHINGLE, -1
    runs: list[list[tuple[int, tuple[bytes, ...]]]] = []
    for k, shingle in enumerate(shingles):
        if shingle in wanted:
            at = next((i for i in wanted[shingle] if i > at), -1)
            if not runs or at < 0 or k - runs[-1][-1][0] > gap:
                runs.append([])
                at = wanted[shingle][0]
            runs[-1].append((k, shingle))
    since: set[tuple[bytes, ...]] = set()
    for last, run in enumerate(runs):
        since.update(s for _, s in run)
        if len(since) >= need:
            held: set[tuple[bytes, ...]] = set()
            first = last + 1
            while len(held) < need:
                first -= 1
                held.update(s for _, s in runs[first])
            yield len(held) / len(wanted), runs[first][0][0], run[-1][0]
            since = set()


def _key(minima: list) -> np.ndarray:
    key = minima[0]
    for more in minima[1:]:
        key = (key * _BASE) ^ more
    return key


def _window_minima(values: np.ndarray, size: int, step: int, count: int) -> np.ndarray:
    """Minimum of each window of ``size`` that starts at a multiple of ``step``."""
    blocks = np.minimum.reduceat(values, np.arange(0, len(values), step)) if step > 1 else values
    per = -(-size // step)  # blocks that a window touches; the last may reach past its end
    minima = blocks[:count].copy()
    for k in range(1, per):
        later = blocks[k : k + count]
        np.minimum(minima[: len(later)], later, out=minima[: len(later)])
    return minima


def _merged(windows: list[tuple[int, int]], slack: int) -> Iterator[tuple[int, int]]:
    """Regions around the windows, a template's length wider on both sides where there is room."""
    slack = slack // 4
    first, last = windows[0][0] - slack, windows[0][1] + slack
    for start, end in windows[1:]:
        if start - slack > last:
            yield first, last
            first = start - slack
        last = max(last, end + slack)
    yield first, last


def notices(text: Column, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Column:
    """array<struct<license, containment, first_word, last_word>> of a text."""

    @F.arrow_udf("array<struct<license:string,containment:double,first_word:int,last_word:int>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(templates)
        names = ("license", "containment", "first_word", "last_word")
        kind = pa.list_(pa.struct([(names[0], pa.string()), (names[1], pa.float64()), (names[2], pa.int32()), (names[3], pa.int32())]))
        for batch in batches:
            yield pa.array([[dict(zip(names, hit)) for hit in found] for found in scanner.find_each(batch.to_pylist())], kind)

    return of(text)


def op5(docs: DataFrame) -> DataFrame:
    """(doc_id, license, containment, first_word, last_word) per notice found; words count from 0.

    Words are runs of letters and digits, lower-cased. NULL, empty and shorter texts than five words
    hold no notice; repeated rows give repeated notices; an empty table gives none.
    """
    return docs.select("doc_id", notices(F.col("text")).alias("found")).select("doc_id", F.inline("found"))
