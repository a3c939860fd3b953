"""License scans: winnowed fingerprints of templates find candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._common import table
from quern.llm.decontaminate import WORD, grams, words_of

#: Words of a fingerprint at most.
GRAM = 3
#: Share of a template's words that must match; width of the alignment's band at each side of the diagonal.
COVERAGE, BAND_SHARE, LEAST_BAND = 0.8, 0.15, 4
MATCH, MISMATCH, GAP = 2, -1, -1

TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-statement": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0-statement": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSD-3-Clause-third": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "CC0-1.0-statement": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "Public-domain-notice": "This work is released into the public domain.",
    "All-rights-reserved": "Copyright. All rights reserved. No part of this publication may be reproduced without written permission.",
}


def run_left(n: int, coverage: float) -> int:
    """Words of the longest run that is left at least of n words, wherever as many of them are edited as coverage allows."""
    edits = n - math.ceil(coverage * n - 1e-9)
    return max(1, -(-(n - edits) // (edits + 1)))


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least gram of each ``window`` neighbours, the last one of equals; of fewer grams the least."""
    if not len(h):
        return np.zeros(0, np.int64)
    window = min(window, len(h))
    near = np.lib.stride_tricks.sliding_window_view(h[::-1], window)
    return np.unique(len(h) - 1 - (np.arange(len(near)) + near.argmin(axis=1)))


class Templates:
    """The inverted index: fingerprint -> (template, position), one for each number of words of a fingerprint.

    A template's fingerprints are so long, and taken of so many neighbours, that any run has one which is as long as the
    longest run that edits can leave; so a short notice has more of them, and shorter ones, than a long text.
    """

    def __init__(self, templates: dict[str, str], coverage: float):
        self.names, self.coverage = list(templates), coverage
        self.number: dict[str, int] = {}
        self.coded = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(t)], np.uint64) for t in templates.values()]
        self.where: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, w in enumerate(self.coded):
            run = run_left(len(w), coverage)
            size = min(GRAM, run)
            h = grams(w, size)
            for p in winnow(h, run - size + 1).tolist():
                self.where.setdefault(size, {}).setdefault(int(h[p]), []).append((k, p))
        self.keys = {size: np.sort(np.fromiter(where, np.uint64)) for size, where in self.where.items()}

    def _starts(self, w: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, position in it, position in the text) of each fingerprint that both have."""
        known = w > 0
        for size, keys in self.keys.items():
            full = known[: max(0, len(w) - size + 1)].copy()
            for k in range(1, size):
                full &= known[k : len(w) - size + 1 + k]
            if not full.any():
                continue
            h = grams(w, size)
            at = np.flatnonzero(full)
            at = at[keys[np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)] == h[at]]
            for p in at.tolist():
                for k, q in self.where[size][int(h[p])]:
                    yield k, q, p

    def spans(self, text: str | None) -> list[tuple]:
        """(template, matched words, coverage, identity, first and end character), best first where spans overlap."""
        words, coverage = words_of(text), self.coverage
        get = self.number.get
        w = np.fromiter((get(x, 0) for x in words), np.uint64, len(words))
        diagonals: dict[int, list[int]] = {}
        for k, q, p in self._starts(w):
            diagonals.setdefault(k, []).append(p - q)
        found = []
        for k, ds in diagonals.items():
            n = len(self.coded[k])
            band = max(LEAST_BAND, int(BAND_SHARE * n))
            ds.sort()
            first = ds[0]
            for a, b in zip(ds, [*ds[1:], None]):
                if b is not None and b - first <= band:
                    continue
                matched, columns, lo, hi = banded(self.coded[k].astype(np.int64), w.astype(np.int64), (first + a) // 2, band)
                if matched >= coverage * n:
                    found.append((matched, matched / n, matched / columns, lo, hi, k))
                first = b
        if not found:
            return []
        found.sort(key=lambda x: (-x[0], -x[1], x[3], self.names[x[5]]))
        kept: list[tuple] = []
        for f in found:
            if all(f[4] <= g[3] or f[3] >= g[4] for g in kept):
                kept.append(f)
        at = [m.span() for m in WORD.finditer(text)] if text.lower().isascii() else _places(text)
        return [(self.names[k], m, c, i, at[lo][0], at[hi - 1][1]) for m, c, i, lo, hi, k in sorted(kept, key=lambda x: x[3])]


def _places(text: str) -> list[tuple[int, int]]:
    """Spans in ``text`` of the words of its lower-case form, which may have more characters."""
    back = [k for k, c in enumerate(text) for _ in c.lower()]
    return [(back[m.start()], back[m.end() - 1] + 1) for m in WORD.finditer("".join(c.lower() for c in text))]


def banded(item: np.ndarray, words: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int, int]:
    """Local alignment within ``band`` of a diagonal: (matched words, columns, first and end word)."""
    n, width = len(item), 2 * band + 1
    padded = np.full(n + width, -1, np.int64)
    lo = diagonal - band
    a, b = max(0, lo), min(len(words), lo + n + width)
    if b > a:
        padded[a - lo : b - lo] = words[a:b]
    h = np.zeros((n + 1, width + 1), np.int32)  # column d: item word i-1 stands at padded word i-1+d
    step = np.arange(width, dtype=np.int32) * GAP
    for i in range(1, n + 1):
        row = np.maximum(h[i - 1, :width] + np.where(padded[i - 1 : i - 1 + width] == item[i - 1], MATCH, MISMATCH), h[i - 1, 1:] + GAP)
        h[i, :width] = np.maximum.accumulate(np.maximum(row, 0) - step) + step
    i, d = (int(x) for x in np.unravel_index(int(h.argmax()), h.shape))
    end, matched, columns = i + d, 0, 0
    while i > 0 and h[i, d] > 0:
        same = padded[i - 1 + d] == item[i - 1]
        columns += 1
        if h[i, d] == h[i - 1, d] + (MATCH if same else MISMATCH):
            matched += int(same)
            i -= 1
        elif h[i, d] == h[i - 1, d + 1] + GAP:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return matched, max(columns, 1), lo + i + d, lo + end


@cache
def _templates(items: tuple, coverage: float) -> Templates:
    return Templates(dict(items), coverage)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per license statement of a document: id, license, matched, coverage, identity, start, end.

    matched counts words, coverage is their share of the template's, identity their share of the alignment's columns;
    start and end are code points in the text. Of overlapping spans the one with most matched words is reported. All
    grams of whole texts are looked up, in one pass without a shuffle; the index of templates is part of the program.
    Every statement with ``coverage`` of a template's words is found if what differs are words left out or replaced; words
    put between can break all runs, and an alignment that leaves its band (15 % of the template, 4 words at least).
    Of spans with as many matched words the one of greater coverage is reported, then the first, then by name.
    Null and empty texts have no rows; a null id is passed through; repeated rows are reported each; other columns are
    ignored; no rows give no rows.
    """
    items = tuple((templates or TEMPLATES).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _templates(items, coverage)
        for b in batches:
            got = [(r, *x) for r, t in enumerate(b.column("t")) for x in index.spans(t.as_py())]
            if got:
                row, *cols = zip(*got)
                types = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.record_batch([b.column("id").take(pa.array(row)), *(pa.array(c, t) for c, t in zip(cols, types))], ["id", "license", "matched", "coverage", "identity", "start", "end"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return src.mapInArrow(run, "id long, license string, matched long, coverage double, identity double, start long, end long").withColumnRenamed("id", id_col)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
