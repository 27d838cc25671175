"""Licence scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Windows: a template of at most WINDOW words is one window of its own length, a longer one is cut into windows of WINDOW
words that overlap by half. A document is cut into windows of each length that templates have, at every step of an
eighth of that length. A window without any shingle of any template has no minimum in common with one, so only windows
that hold a template's shingle are hashed; no collision is lost by that. Minima of all windows of a slice come from
running minima of doubling width, one pass for each hash function.

Bands: BANDS bands of 2 minima meet with a probability of 1 - (1 - s^2)^BANDS; at a window similarity of s = 0.5 that is
0.9999. Verification counts the template's five-word shingles (words in lower case, without punctuation at their ends)
that the document has in one stretch of a quarter more than the template's length, exactly; a template counts from
CONTAINMENT on.

The templates are short notices (TEMPLATES) and whole licence texts (the files in licence_texts, public wording); a
caller may pass others.

Defined results: null and empty texts and templates match nothing; very long texts are scanned as a whole; a template of one to four words is one shingle that
only a text of just these words has; equal templates each match; repeated rows match each; a template that occurs
several times gives its first place and the number of places; an empty table on either side gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._arrow import share_code, slices, text_buffers
from tessera.llm._words import mix, normalised_words, shingles

WIDTH = 5
WINDOW = 64
BANDS, ROWS = 32, 2
CONTAINMENT = 0.8

#: Short notices by which texts name their licence (public wording).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def default_templates() -> dict[str, str]:
    """The short notices and the licence texts."""
    files = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
    return TEMPLATES | {f.stem: f.read_text(encoding="utf-8") for f in files}


def _band_keys(hashes: np.ndarray, starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The band keys (a row for a window) of the windows of ``hashes`` that begin at ``starts`` and are ``widths`` long."""
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64), 99), (len(starts), BANDS)).copy()
    steps = np.floor(np.log2(widths)).astype(np.int64)
    groups = [(j, np.flatnonzero(steps == j)) for j in np.unique(steps).tolist()]
    for k in range(BANDS * ROWS):
        least, width = mix(hashes, 100 + k), 1  # minima of ``width`` hashes from each place
        own = np.empty(len(starts), np.uint64)
        for j, at in groups:
            while width < 1 << j:
                least, width = np.minimum(least[:-width], least[width:]), 2 * width
            own[at] = np.minimum(least[starts[at]], least[starts[at] + widths[at] - width])
        keys[:, k // ROWS] = mix(keys[:, k // ROWS] ^ own, 98)
    return keys


class Scanner:
    """The templates' windows by band key."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names: list[str] = []
        self.bags: list[np.ndarray] = []
        self.sizes: list[int] = []
        windows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for name, text in templates:
            words, rows = normalised_words(pa.array([text or ""]))
            if not len(words):
                continue
            bag = shingles(words, rows, WIDTH)[0]
            number, size = len(self.names), min(len(words), WINDOW)
            self.names.append(name), self.bags.append(np.unique(bag)), self.sizes.append(len(words))
            width = max(1, size - WIDTH + 1)
            last = len(bag) - width
            starts = np.array(sorted({*range(0, last + 1, max(1, size // 2)), last}))
            keys = np.unique(_band_keys(bag, starts, np.full(len(starts), width)))
            windows[size].append((keys, np.full(len(keys), number)))
        #: For each window length the band keys in order, and the template of each.
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, parts in windows.items():
            keys, numbers = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(keys, kind="stable")
            self.tables[size] = keys[order], numbers[order]
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.bags]))

    def scan(self, texts: pa.Array) -> list[tuple[int, str, float, int, int, int]]:
        """(row, template, containment, first word, word after the last, places)."""
        hashes, rows = shingles(*normalised_words(texts), WIDTH)
        if not len(hashes) or not len(self.known):
            return []
        place = np.searchsorted(self.known, hashes)
        place[place == len(self.known)] = 0
        hits = np.flatnonzero(self.known[place] == hashes)
        if not len(hits):
            return []
        found: list[np.ndarray] = []
        for size, (keys, numbers) in self.tables.items():
            starts, widths = self._windows(hits, rows, size)
            # Only what lies in some window is hashed; a window stays in one piece.
            inside = np.zeros(len(hashes) + 1, np.int32)
            np.add.at(inside, starts, 1)
            np.add.at(inside, starts + widths, -1)
            near = np.cumsum(inside[:-1]) > 0
            moved = np.cumsum(near) - near
            own = _band_keys(hashes[near], moved[starts], widths)
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            many = (high - low).ravel()
            at = np.repeat(np.repeat(starts, BANDS), many)
            which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low.ravel(), many)
            found.append(np.unique(np.column_stack([np.searchsorted(rows, at, "right") - 1, numbers[which]]), axis=0))
        out = []
        for row, number in np.unique(np.concatenate(found), axis=0).tolist():
            a, b = np.searchsorted(hits, rows[row : row + 2])
            best = self._verified(hashes[rows[row] : rows[row + 1]], hits[a:b] - rows[row], number)
            if best:
                out.append((row, self.names[number], *best))
        return out

    def _windows(self, hits: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and widths of the windows of ``size`` words that hold a hit: at each eighth of the length, and the last one of a text."""
        width, step = max(1, size - WIDTH + 1), max(1, size // 8)
        row = np.searchsorted(rows, hits, "right") - 1
        begin, end = rows[row], rows[row + 1]
        low = np.maximum(hits - width + 1, begin)
        first = begin + -(-(low - begin) // step) * step
        many = np.maximum(0, (np.minimum(hits, end - width) - first) // step + 1)
        starts = np.repeat(first, many) + step * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        last = np.maximum(begin, end - width)
        starts = np.unique(np.concatenate([starts, last[last + width > hits]]))
        return starts, np.minimum(width, rows[np.searchsorted(rows, starts, "right")] - starts)

    def _verified(self, bag: np.ndarray, hits: np.ndarray, number: int) -> tuple[float, int, int, int] | None:
        """The greatest containment in a stretch of the text, where it is, and in how many places the template is."""
        template = self.bags[number]
        which = np.searchsorted(template, bag[hits])
        which[which == len(template)] = 0
        mine = template[which] == bag[hits]
        hits, which = hits[mine], which[mine]
        ends = np.searchsorted(hits, hits + stretch(self.sizes[number]))
        need = CONTAINMENT * len(template)
        best, places, until = None, 0, -1
        if (ends - np.arange(len(hits)) < need).all():
            return None
        held = np.zeros(len(template), np.int64)
        distinct, b = 0, 0
        places_of, shingle, position = ends.tolist(), which.tolist(), hits.tolist()
        for a, end in enumerate(places_of):
            for k in shingle[b:end]:
                distinct += not held[k]
                held[k] += 1
            b = end
            if distinct >= need:
                first, last = position[a], position[b - 1] + WIDTH
                if first >= until:
                    places, until = places + 1, last
                if best is None or (distinct, first - last) > best[0]:
                    best = ((distinct, first - last), first, last)
            held[shingle[a]] -= 1
            distinct -= not held[shingle[a]]
        return (best[0][0] / len(template), *best[1:], places) if best else None


def stretch(words: int) -> int:
    """Shingles of the stretch in which a template of so many words has to be: a quarter more than its own."""
    own = max(1, words - WIDTH + 1)
    return own + own // 4


@cache
def _scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    """One for a worker."""
    return Scanner(list(templates))


def scan(df: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, containment, first_word, last_word, places: a row for each document and template found in it.

    Positions count normalised words, the last exclusive. Templates are a parameter and are broadcast.
    """
    share_code(df.sparkSession)
    own = df.sparkSession.sparkContext.broadcast(tuple(sorted((default_templates() if templates is None else templates).items())))
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "license", "containment", "first_word", "last_word", "places"]
    kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(own.value)
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for a, b, _, _ in slices(*text_buffers(texts)):
                rows = scanner.scan(texts.slice(a, b - a))
                if rows:
                    r, *rest = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(r)), *(pa.array(v, k) for v, k in zip(rest, kinds, strict=True))], names=names)

    return docs.mapInArrow(step, "doc_id long, license string, containment double, first_word long, last_word long, places long")


def brute_force(rows: list[tuple[int, str | None]], templates: dict[str, str] | None = None) -> set[tuple[int, str]]:
    """Document and template pairs by sliding over every place, from strings alone; for tests."""
    import string

    def runs(text: str | None) -> list[tuple[str, ...]]:
        words = [w for w in (w.strip(string.punctuation) for w in re.split("[ \t-\r]+", (text or "").lower())) if w]
        return [tuple(words[k : k + WIDTH]) for k in range(max(1, len(words) - WIDTH + 1))] if words else []

    out = set()
    texts = {d: runs(t) for d, t in rows}
    for name, text in (default_templates() if templates is None else templates).items():
        whole = runs(text)
        bag, reach = set(whole), len(whole) + len(whole) // 4
        for d, own in texts.items():
            if bag and len(bag & set(own)) >= CONTAINMENT * len(bag) and any(len(bag & set(own[k : k + reach])) >= CONTAINMENT * len(bag) for k in range(len(own)) if own[k] in bag):
                out.add((d, name))
    return out
