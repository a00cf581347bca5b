"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import read_table

# Paragraphs that several public licences share.
_NO_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
    "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
    "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
    "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Name and text of each template: notices, openings and, where "(whole)" stands, whole texts of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 (notice)": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
        "OF ANY KIND, either express or implied."
    ),
    "MIT": "Released under the MIT License",
    "MIT (text)": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL (notice)": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "BSD (text)": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer."
    ),
    "ISC (text)": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0 (notice)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense (text)": "This is free and unencumbered software released into the public domain.",
    "MIT (whole)": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
        "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. " + _NO_WARRANTY
    ),
    "BSD-2-Clause (whole)": _BSD + _BSD_END,
    "BSD-3-Clause (whole)": _BSD + _BSD_THIRD + _BSD_END,
    "ISC (whole)": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies. " + _ISC_END
    ),
    "0BSD (whole)": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END,
    "Zlib (whole)": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
        "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any "
        "source distribution."
    ),
    "BSL-1.0 (whole)": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this "
        "license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to "
        "permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, "
        "including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all "
        "derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source "
        "language processor."
    ),
    "Unlicense (whole)": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright "
        "laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the "
        "benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity "
        "of all present and future rights to this software under copyright law."
    ),
    "LGPL (notice)": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free "
        "Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "AGPL (notice)": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "EPL-2.0 (notice)": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "CC0-1.0 (notice)": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
}
#: Words in a fingerprint, and fingerprints in a winnowing window: runs of GRAM + WINDOW - 1 equal words always meet.
GRAM, WINDOW = 3, 2
#: Off-diagonal words of the alignment, and the least share of a template that must match.
BAND, COVERAGE = 8, 0.8
#: What a word of the text between two that match costs, and the least share of a match's span that must match.
GAP, DENSITY = 0.25, 0.6

WORD = re.compile(rb"[0-9a-z]+(?:[.+-][0-9a-z]+)*")
WORD_IN = re.compile(r"[0-9A-Za-z]+(?:[.+-][0-9A-Za-z]+)*")


@dataclass(frozen=True)
class Match:
    license: str
    coverage: float
    matched: int
    start: int
    end: int


class TemplateIndex:
    """Inverted index from fingerprint to places in the templates; its size is that of the templates."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        words = [WORD.findall(t.encode().lower()) for t in templates.values()]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for x in words for w in x}), 1)}
        self.tokens = [np.array([self.vocabulary[w] for w in x], np.int64) for x in words]
        self.places: dict[int, list[tuple[int, int]]] = {}
        for t, ids in enumerate(self.tokens):
            for pos, h in zip(*winnow(ids)):
                self.places.setdefault(int(h), []).append((t, int(pos)))
        self.known = np.array(sorted(self.places), np.uint64)

    def seeds(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each template the places in the text where a fingerprint of it stands, in order, with their diagonals."""
        pos, h = winnow(ids)
        keep = np.isin(h, self.known)
        by: dict[int, list[tuple[int, int]]] = {}
        for p, x in zip(pos[keep].tolist(), h[keep].tolist()):
            for t, at in self.places[x]:
                by.setdefault(t, []).append((p, p - at))
        return by

    def align(self, text: list[int], at: int, t: int, first: int, last: int) -> tuple[float, int, int, int]:
        """Best local alignment of a template in the band around the diagonals from first to last: a word that matches
        counts 1, a word of the text between two that match costs GAP. ``text`` starts at word ``at`` of the whole.

        Returns score, matched words and the span of them in the whole text; of equal scores the earliest."""
        tokens = self.tokens[t].tolist()
        lo, hi = first - BAND - at, last + BAND - at
        none = (0.0, 0, 0)  # score, -matched, first word
        above: dict[int, tuple[float, int, int]] = {}  # best path whose last match is at or before a place of the text
        best = (0.0, 0, 0, 0)
        for i, w in enumerate(tokens):
            row: dict[int, tuple[float, int, int]] = {}
            left = none
            for j in range(max(0, i + lo), min(len(text), i + hi + 1)):
                here = max(above.get(j, none), (left[0] - GAP, left[1], left[2]) if left[0] > GAP else none)
                if text[j] == w:
                    s, n, f = above.get(j - 1, none)
                    if s > 0 and (x := (s + 1, n - 1, f)) > here or (x := (1.0, -1, j)) > here:
                        here = x
                        if (x[0], -j) > (best[0], -best[3]):
                            best = (x[0], -x[1], x[2], j)
                row[j] = left = here
            # what the band leaves behind on the right is still a path for the next word of the template
            above = row
        s, n, f, l = best
        return s, n, f + at, l + at

    def scan(self, text: str | None) -> list[Match]:
        """Matches of a whole text in order; of two that overlap the one with more matched words stays. Each copy of a
        notice is a match of its own: what a match covers is masked, and the rest is aligned again."""
        if not text:
            return []
        get = self.vocabulary.get
        words = np.array([get(w, 0) for w in WORD.findall(text.encode().lower())], np.int64)
        found = []
        for t, seeds in self.seeds(words).items():
            found += [(-n, -n / len(self.tokens[t]), a, b, t) for n, a, b in self.copies(words, t, seeds)]
        if not found:
            return []
        spans = [m.span() for m in WORD_IN.finditer(text)]
        kept: list[tuple[int, int, int, int]] = []
        taken: list[tuple[int, int]] = []  # spans of kept, in order; no two of them overlap
        for n, _, a, b, t in sorted(found):
            at = bisect.bisect_left(taken, (a, b))
            if (at == len(taken) or taken[at][0] > b) and (at == 0 or taken[at - 1][1] < a):
                taken.insert(at, (a, b))
                kept.append((-n, a, b, t))
        return [
            Match(self.names[t], n / len(self.tokens[t]), n, spans[a][0], spans[b][1])
            for n, a, b, t in sorted(kept, key=lambda k: k[1])
        ]

    def copies(self, words: np.ndarray, t: int, seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(matched, first word, last word) of each copy of a template. Seeds on near diagonals within the reach of one
        copy are aligned together, so a candidate never spans more than a copy and its band."""
        size, reach, out = len(self.tokens[t]), len(self.tokens[t]) + BAND, []
        free, i = [True] * len(seeds), 0
        masked: dict[int, int] = {}  # words of matches, by place
        while i < len(seeds):
            if not free[i]:
                i += 1
                continue
            p, d = seeds[i]
            chain = [i]
            for j in range(i + 1, len(seeds)):
                if seeds[j][0] > p + reach:
                    break
                if free[j] and abs(seeds[j][1] - d) <= BAND:
                    chain.append(j)
            first, last = min(seeds[j][1] for j in chain), max(seeds[j][1] for j in chain)
            at = max(0, first - BAND)
            part = words[at : max(0, last + BAND + size)].tolist()
            for k in range(len(part)):
                if at + k in masked:
                    part[k] = -1
            _, n, a, b = self.align(part, at, t, first, last)
            if n and n >= COVERAGE * size and n >= DENSITY * (b - a + 1):
                out.append((n, a, b))
                masked.update(dict.fromkeys(range(a, b + 1), t))
                hit = [j for j in chain if a - GRAM < seeds[j][0] <= b]
            else:
                hit = chain
            for j in hit or chain:
                free[j] = False
        return out


def winnow(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints kept: the least hash of each window, the last of equal ones. Grams with
    a word unknown to the templates (0) count as largest and are never kept. Fewer words than a gram make one."""
    if not len(ids):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    n = max(1, len(ids) - GRAM + 1)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(min(GRAM, len(ids))):
        part = ids[k : k + n]
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        known &= part > 0
    top = np.uint64(2**64 - 1)
    h = np.where(known, h, top)
    if n <= WINDOW:
        keep = {int(n - 1 - np.argmin(h[::-1]))}
        at = np.array(sorted(keep))
    else:
        w = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
        at = np.unique(np.arange(len(w)) + WINDOW - 1 - np.argmin(w[:, ::-1], axis=1))
    at = at[h[at] != top]
    return at, h[at]


@functools.cache
def _index(templates: tuple[tuple[str, str], ...]) -> TemplateIndex:
    return TemplateIndex(dict(templates))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """doc_id, license, coverage, matched, start, end (code points, end exclusive): one row for each match.

    One scan of every whole text without a shuffle. Each copy of a notice is a row with its own span, however many
    follow each other; a copy is found if four of its words in a row are unchanged. Null and empty texts and empty tables give no rows; repeated
    rows give their matches each; null doc_ids are kept; other columns are ignored."""
    fixed = tuple((templates or TEMPLATES).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(fixed)
        for b in batches:
            rows = [(d, m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in index.scan(t)]
            kinds = [("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in rows], pa.int64()), *(pa.array([getattr(m, k) for _, m in rows], t) for k, t in kinds)],
                ["doc_id", *(k for k, _ in kinds)],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        run, "doc_id long, license string, coverage double, matched long, start long, end long"
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
