"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Texts and templates are taken as lower-cased runs of letters and digits, and as shingles of SHINGLE such words. A template
of s shingles belongs to the window class of the least power of two W with s <= 3/4 W; windows of W shingles begin at every
quarter of W, so one of them holds the whole passage. A window's signature has BANDS minima, of one hash function each; a
window that equals a template in one band retrieves it. A passage with THRESHOLD of the template's shingles has a Jaccard
similarity of at least 0.28 with that window, and so is retrieved with a chance of 1 - 0.72^BANDS, over 0.9999. Minima of
larger windows are those of two halves, so all classes together cost about twice the first.

Retrieved templates are verified around the window: where the distinct shingles of the template that occur within a
stretch of its own length (and a quarter more) make up THRESHOLD of its shingles, the passage is a match. Of matches
that overlap, the one with the most of its template stays.

Defined results: null text counts as empty (no license); null doc_ids are kept; repeated rows are scanned each; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.common import byte_texts, map_batches, only, table
from sylva.llm.wordhash import ALNUM, chunks, mix, shingle_hashes, word_table

SHINGLE, THRESHOLD, BANDS, SEED = 5, 0.8, 40, 20240229

#: Well-known license texts and notices (names as in the SPDX list, where it has one).
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "AllRightsReserved": ("All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",),
}


class Matcher:
    """The templates' signatures, by window class, and their shingles."""

    def __init__(self, templates: dict[str, tuple[str, ...]], shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS):
        self.shingle, self.threshold, self.bands = shingle, threshold, bands
        self.names = [n for n, texts in templates.items() for _ in texts]
        self.sets: list[np.ndarray] = []
        self.lengths: list[int] = []
        rng = np.random.default_rng(SEED)
        self.factors = rng.integers(1, 1 << 63, bands, dtype=np.uint64) | np.uint64(1)
        self.classes: dict[int, list[int]] = {}
        for text in (t for texts in templates.values() for t in texts):
            h, row, _, _ = word_table([text.encode()], ALNUM)
            g, _, _ = shingle_hashes(h, row, shingle)
            if not len(g):
                raise ValueError(f"a template has fewer than {shingle} words: {text!r}")
            self.sets.append(np.unique(g))
            self.lengths.append(len(g))
            width = 4
            while len(g) > 3 * width / 4:
                width *= 2
            self.classes.setdefault(width, []).append(len(self.sets) - 1)
        # of each class and band: the templates' minima, and a table of their first 16 bits that leaves out most windows
        self.minima = {w: [np.array([(self.sets[t] * f).min() for t in ts], np.uint64) for f in self.factors] for w, ts in self.classes.items()}
        self.first = {w: [np.bincount((m >> np.uint64(48)).astype(np.int64), minlength=1 << 16) > 0 for m in ms] for w, ms in self.minima.items()}

    def retrieve(self, g: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first shingle, width) of windows of the shingles g that equal a template in a band."""
        found = set()
        widest = max(self.classes)
        for band, factor in enumerate(self.factors):
            low, width = g * factor, 1  # minima of windows of `width` at steps of max(1, width / 4)
            step = 1
            while width < widest:
                width *= 2
                shift = width // 2 // step
                if len(low) > shift:
                    low = np.concatenate([np.minimum(low[:-shift], low[shift:]), low[-shift:]])  # at the end, windows are cut off
                if width >= 8:
                    low, step = low[::2], step * 2
                if width in self.classes:
                    near = np.flatnonzero(self.first[width][band][(low >> np.uint64(48)).astype(np.int64)])
                    if len(near):
                        same = low[near][:, None] == self.minima[width][band][None, :]
                        for i, t in zip(*np.nonzero(same)):
                            found.add((self.classes[width][t], int(near[i]) * step, width))
        return found

    def verify(self, g: np.ndarray, row: np.ndarray, found: set[tuple[int, int, int]]) -> list[tuple[int, int, int, int, float]]:
        """(row, template, first and last shingle, containment) of the passages around retrieved windows."""
        out = []
        spans: dict[int, list[list[int]]] = {}
        for t, at, width in sorted(found):
            lo, hi = max(0, at - self.lengths[t]), min(len(g), at + width + self.lengths[t])
            own = spans.setdefault(t, [])
            if own and lo <= own[-1][1]:
                own[-1][1] = max(own[-1][1], hi)
            else:
                own.append([lo, hi])
        for t, ranges in spans.items():
            need, reach = self.threshold * len(self.sets[t]), self.lengths[t] + max(1, self.lengths[t] // 4)
            for lo, hi in ranges:
                hits = lo + np.flatnonzero(np.isin(g[lo:hi], self.sets[t]))
                i, last = 0, -1
                while i < len(hits):
                    part = hits[i : np.searchsorted(hits, hits[i] + reach)]
                    part = part[row[part] == row[hits[i]]]
                    got = len(np.unique(g[part]))
                    if hits[i] > last and got >= need:
                        last = int(part[-1])
                        out.append((int(row[hits[i]]), t, int(hits[i]), last, got / len(self.sets[t])))
                    i += 1
        return out

    def scan(self, rows: list[bytes]) -> list[list[tuple[str, int, int, float]]]:
        """Per row: (name, start, end, containment), spans in bytes."""
        out: list[list] = [[] for _ in rows]
        for first, part in chunks(rows):
            h, word_row, start, end = word_table(part, ALNUM)
            g, row, word = shingle_hashes(h, word_row, self.shingle)
            for r, t, a, b, share in self.verify(g, row, self.retrieve(g)):
                out[first + r].append((self.names[t], int(start[word[a]]), int(end[word[b] + self.shingle - 1]), share))
        return [distinct(x) for x in out]


def distinct(matches: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Of overlapping matches the one with the most of its template, then the longest; by start, then name."""
    out: list = []
    for m in sorted(matches, key=lambda m: (-m[3], m[1] - m[2], m[1], m[0])):
        if not any(m[1] < o[2] and o[1] < m[2] for o in out):
            out.append(m)
    return sorted(out, key=lambda m: (m[1], m[0]))


SCHEMA = "doc_id bigint, matches array<struct<name:string,start:int,end:int,containment:double>>"


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per document: doc_id and its matches (name, start, end in code points, containment)."""
    templates = templates or TEMPLATES

    def make():
        matcher = Matcher(templates)

        def step(batch):
            if batch is None or not batch.num_rows:
                return
            rows = byte_texts(batch)
            found = []
            for raw, matches in zip(rows, matcher.scan(rows)):
                place = lambda n, raw=raw: len(raw[:n].decode())
                found.append([{"name": n, "start": place(s), "end": place(e), "containment": c} for n, s, e, c in matches])
            yield {"doc_id": batch.column("doc_id"), "matches": found}

        return step

    return map_batches(only(docs, "doc_id", "text"), make, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["name"])))
    spans = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["name"], m["start"].cast("string"), m["end"].cast("string"))), ",")
    return out.select("doc_id", F.size(names).cast("bigint").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), spans.alias("spans"))


SQL = None  # windows and minima can't be said in SQL; tests hold the query against planted passages
