"""Licence scans: Dice coefficient over word bigrams between normalised text and templates.

Templates are the full texts of 12 licences (the files in ``licenses``), their longer
paragraphs, standard notices, and SPDX tags. The units of a text are its lines, its
paragraphs (runs of lines that aren't blank) and the whole text; a licence inside a longer
unit is found in windows as long as the template. A unit is lower-cased and cut into runs of
letters and digits. With A and B the bigram sets of unit and template, 2|A & B| / (|A| + |B|)
can't reach t unless |A| lies between |B| t / (2 - t) and |B| (2 - t) / t, and |A & B| is at least
|B| t / (2 - t): only templates within these bounds are compared. Each unit keeps its best template
(of equal ones the first by name), each template all windows that reach t, so a licence that occurs again is found
again. Of matches that overlap, the one with the most common bigrams stays, of equal ones the one of the larger
coefficient, then the earlier, then the first by name.

Everything happens inside a row: nothing is shuffled; the templates are a constant of about
200 KB that is broadcast.

Edge cases: null and empty texts, and units of fewer than two words, match nothing; a text of any
length is searched whole; each input row gives a row, repeated rows and null ids included
(licenses empty where none is found); of equal Dice coefficients the first name wins; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import ceil
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

THRESHOLD = 0.8
#: Bigrams that a paragraph of a licence needs to be a template of its own.
PARAGRAPH = 20

# Public identifiers and the names that notices use.
NAMES = {
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "the GNU AGPLv3", "the AGPL-3.0 license"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache 2.0 License"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the New BSD License"),
    "CC-BY-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0 Universal", "the Creative Commons CC0 1.0 Universal Public Domain Dedication"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU GPLv2", "the GPL-2.0 license"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU GPLv3", "the GPL-3.0 license"),
    "ISC": ("the ISC License",),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1", "the GNU LGPLv2.1", "the LGPL-2.1 license"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "the GNU LGPLv3", "the LGPL-3.0 license"),
    "MIT": ("the MIT License", "the terms of the MIT License"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the MPL 2.0"),
    "Unlicense": ("the Unlicense",),
}
FORMS = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This software is licensed under {}.", "This project is released under {}.")
FAMILIES = {"AGPL": "GNU Affero General Public License", "GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License"}
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
GNU_NOTICE = "{} is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."

_WORD = re.compile(r"[^\W_]+")


def bigrams(text: str) -> set[tuple[str, str]]:
    w = _WORD.findall(text.lower())
    return set(zip(w, w[1:]))  # noqa: B905


def license_texts() -> dict[str, str]:
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


@lru_cache(1)
def default_templates() -> list[tuple[str, str]]:
    """(name, text), sorted: notices, SPDX tags, full texts, and paragraphs that only one licence has."""
    out = [(k, f.format(n)) for k, names in NAMES.items() for n in names for f in FORMS] + list(NOTICES.items())
    for k in NAMES:
        out += [(k, f"SPDX-License-Identifier: {k}{end}") for end in ("", "-only", "-or-later")[: 3 if "GPL" in k else 1]]
        family, _, version = k.partition("-")
        if family in FAMILIES:
            out += [(k, GNU_NOTICE.format(what, FAMILIES[family], version.removesuffix(".0"))) for what in ("This program", "This library", "This file")]
        if k.startswith("CC"):
            path = "publicdomain/zero/1.0" if k == "CC0-1.0" else f"licenses/{k[3:-4].lower()}/4.0"
            out.append((k, f"To view a copy of this license, visit http://creativecommons.org/{path}/"))
    texts = license_texts()
    out += texts.items()
    paragraphs = [(k, p) for k, t in texts.items() for p in re.split(r"\n\s*\n", t)]
    shared = Counter(frozenset(b) for _, b in {(k, frozenset(bigrams(p))) for k, p in paragraphs})
    out += [(k, p) for k, p in paragraphs if len(b := bigrams(p)) >= PARAGRAPH and shared[frozenset(b)] == 1]
    return sorted(set(out))


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD):
        self.t = threshold
        found = [(name, _WORD.findall(x.lower())) for name, x in templates or default_templates()]
        found = [(name, w) for name, w in found if len(w) > 1]
        self.templates = [(name, set(zip(w, w[1:]))) for name, w in found]  # noqa: B905
        self.lengths = [len(w) for _, w in found]
        self.least_common = [ceil(len(b) * threshold / (2 - threshold) - 1e-9) for _, b in self.templates]
        self.known: dict[tuple[str, str], list[int]] = {}
        for i, (_, b) in enumerate(self.templates):
            for x in b:
                self.known.setdefault(x, []).append(i)
        sizes = [len(b) for _, b in self.templates]
        self.least, self.most = min(sizes) * threshold / (2 - threshold) - 1e-9, max(sizes) * (2 - threshold) / threshold + 1e-9

    def hits(self, bigrams: set[tuple[str, str]]) -> dict[int, int]:
        """Templates with enough bigrams in common, and how many."""
        out: dict[int, int] = {}
        for x in bigrams & self.known.keys():
            for i in self.known[x]:
                out[i] = out.get(i, 0) + 1
        return {i: n for i, n in sorted(out.items()) if n >= self.least_common[i]}

    def unit(self, words: list[str]) -> tuple[int, float, str] | None:
        """Common bigrams, Dice coefficient and name of the best template at or above the threshold."""
        if len(words) - 1 < self.least:
            return None
        a = set(zip(words, words[1:]))  # noqa: B905
        if not self.least <= len(a) <= self.most:
            return None
        best = None
        for i, n in self.hits(a).items():
            name, b = self.templates[i]
            if len(b) * self.t <= len(a) * (2 - self.t) + 1e-9 and len(a) * self.t <= len(b) * (2 - self.t) + 1e-9:
                dice = 2 * n / (len(a) + len(b))
                if dice >= self.t and (best is None or dice > best[1]):
                    best = (n, dice, name)
        return best

    def windows(self, pairs: list[tuple[str, str]], i: int) -> list[tuple[int, float, str, int, int]]:
        """All windows as long as template i that reach the threshold: common bigrams, Dice coefficient, name, the window's first bigram and the one after its last."""
        name, b = self.templates[i]
        n, size = min(self.lengths[i] - 1, len(pairs)), len(b)
        seen: dict[tuple[str, str], int] = {}
        common, out = 0, []
        for k, x in enumerate(pairs):
            m = seen.get(x, 0)
            seen[x] = m + 1
            common += not m and x in b
            if k >= n:
                y = pairs[k - n]
                seen[y] -= 1
                if not seen[y]:
                    del seen[y]
                    common -= y in b
            if k >= n - 1 and (d := 2 * common / (len(seen) + size)) >= self.t:
                out.append((common, d, name, k - n + 1, k + 1))
        return out

    def text(self, text: str) -> list[tuple[str, float]]:
        """Name and Dice coefficient of the matches, in their order in the text."""
        found, words, first, lines, paragraphs = [], [], 0, 0, 0

        def unit(lo: int) -> None:
            if x := self.unit(words[lo:]):
                found.append((*x, lo, len(words) - 1))

        for line in [*text.split("\n"), ""]:
            more = _WORD.findall(line.lower())
            if more:
                words += more
                lines += 1
                unit(len(words) - len(more))
            elif not line.strip() and lines:
                paragraphs += 1
                if lines > 1:
                    unit(first)
                first, lines = len(words), 0
        if paragraphs > 1:
            unit(0)
        pairs = list(zip(words, words[1:]))  # noqa: B905
        for i in self.hits(set(pairs)):
            found += self.windows(pairs, i)
        # matches that are taken don't overlap, so of those in order only the neighbours can overlap another
        starts: list[int] = []
        taken: dict[int, tuple[int, str, float]] = {}
        for _, d, name, lo, hi in sorted(found, key=lambda x: (-x[0], -x[1], x[3], x[2], x[4])):
            k = bisect_right(starts, lo)
            if (not k or taken[starts[k - 1]][0] <= lo) and (k == len(starts) or hi <= starts[k]):
                starts.insert(k, lo)
                taken[lo] = (hi, name, d)
        return [taken[lo][1:] for lo in starts]


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licenses (sorted names), n_matches, best (largest Dice coefficient; 0 without a match)."""

    sent = docs.sparkSession.sparkContext.broadcast(templates or default_templates())

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(sent.value, threshold)
        for b in batches:
            found = [s.text(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([sorted({k for k, _ in f}) for f in found], pa.list_(pa.string())), pa.array([len(f) for f in found], pa.int64()), pa.array([max((d for _, d in f), default=0.0) for f in found], pa.float64())],
                ["doc_id", "licenses", "n_matches", "best"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(scanned, "doc_id long, licenses array<string>, n_matches long, best double")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
