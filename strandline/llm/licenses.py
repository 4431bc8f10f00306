r"""Licence scans: MinHash bands over overlapping windows retrieve templates, containment verifies.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters;
shingles are five words. A template of s shingles is sought in windows of L
shingles, L being s rounded up to four steps an octave (s itself up to 4), that
begin every ``max(1, L // 4)`` shingles. If at least ``least`` = 0.8 of a template
stands in a text, the window nearest to it has a Jaccard similarity of 0.39 or
more with the template: at most L/8 of the matching shingles fall outside, so
``(0.8 - 1.25/8) / (1 + 1.25 - 0.8 + 1.25/8)``. With bands of one row the chance
that all ``BANDS`` = 20 of them miss is below ``(1 - 0.39)**20`` = 6e-5. Each hit is
verified by the exact share of the template's shingles found within one window
length around it.

Family members share most of their words (versions, "or later", clauses that one has
and the other lacks). Of verified templates whose places overlap, only that stays which
explains most: the one of most shingles found, then of greatest containment.

The templates are few (a parameter), so every worker holds them with their bands.

Edge cases: a null, empty or shorter text matches nothing; a template without five
words is one shingle of its words only and is refused; two licences that explain one place
equally well are both listed; repeated rows are scanned each; a very
long text is scanned whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandline.llm._text import NOT_ALNUM, chunks, distinct, map_arrow, mix

WIDTH, BANDS = 5, 20

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def _gnu(name: str, version: str, later: bool) -> str:
    """The usual notice of the GNU licences."""
    which = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    return f"you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, {which}"


#: Texts and notices of public licences, by SPDX identifier. Short licences stand in full; of the long
#: ones there is the notice that works carry.
TEMPLATES = {
    "0BSD": (f"{_ISC}. {_ISC_WARRANTY}",),
    "AGPL-3.0-only": (_gnu("Affero General Public License", "3", False),),
    "AGPL-3.0-or-later": (_gnu("Affero General Public License", "3", True),),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "Artistic-2.0": ("This program is distributed under the terms of the Artistic License 2.0", "The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    "BSD-2-Clause": (f"{_BSD}: 1. {_BSD_SOURCE} 2. {_BSD_BINARY} {_BSD_WARRANTY}", "This work is released under the BSD 2-Clause License"),
    "BSD-3-Clause": (_BSD, f"{_BSD}: 1. {_BSD_SOURCE} 2. {_BSD_BINARY} 3. {_BSD_NAMES} {_BSD_WARRANTY}", "This work is released under the BSD 3-Clause License"),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-SA-3.0": ("Licensed under CC BY-SA 3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.", "Released under the CC0 1.0 Universal public domain dedication"),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",),
    "GPL-2.0-only": (_gnu("General Public License", "2", False), "This work is licensed under the GNU General Public License, version 2"),
    "GPL-2.0-or-later": (_gnu("General Public License", "2", True),),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3",),
    "GPL-3.0-only": (_gnu("General Public License", "3", False),),
    "GPL-3.0-or-later": (_gnu("General Public License", "3", True),),
    "ISC": (_ISC, f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}"),
    "LGPL-2.1-only": (_gnu("Lesser General Public License", "2.1", False),),
    "LGPL-2.1-or-later": (_gnu("Lesser General Public License", "2.1", True),),
    "LGPL-3.0-only": (_gnu("Lesser General Public License", "3", False),),
    "LGPL-3.0-or-later": (_gnu("Lesser General Public License", "3", True),),
    "MIT": (
        "Released under the MIT License",
        _GRANT,
        _GRANT + """ (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "WTFPL": ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
}
_SALTS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x11CE))


def window_length(shingles: int) -> int:
    """Up to 4 as it is, then rounded up to four steps an octave."""
    if shingles <= 4:
        return shingles
    step = 1 << max(0, (shingles - 1).bit_length() - 3)
    return -(-shingles // step) * step


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]], least: float):
        self.least = least
        flat = [(name, text) for name, texts in templates.items() for text in texts]
        self.names = [name for name, _ in flat]
        self.sets: list[np.ndarray] = []
        for part in chunks(pa.array([t for _, t in flat], pa.large_string()), lower=True):
            w = part.words(NOT_ALNUM)
            at, h = w.windows(w.hashes(), WIDTH)
            for i in range(part.n):
                mine = distinct(h[(at >= w.doc_start[i]) & (at < w.doc_start[i + 1])])
                if not len(mine):
                    raise ValueError(f"template of {flat[part.first + i][0]} has fewer than {WIDTH} words")
                self.sets.append(mine)
        #: window length -> (sorted band keys, template of each)
        self.bands: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in sorted({window_length(len(s)) for s in self.sets}):
            keys, owner = [], []
            for t, s in enumerate(self.sets):
                if window_length(len(s)) == length:
                    for b in range(BANDS):
                        keys.append(self._hash(s, b).min())
                        owner.append(t)
            order = np.argsort(np.array(keys, np.uint64), kind="stable")
            self.bands[length] = np.array(keys, np.uint64)[order], np.array(owner)[order]
        #: which low 16 bits a length's keys have, looked at before the search
        self.maybe = {n: np.isin(np.arange(1 << 16), (keys & np.uint64(0xFFFF)).astype(np.int64)) for n, (keys, _) in self.bands.items()}
        #: lengths at which ``least`` asks for every shingle of a window's length: the first band finds these
        sizes = [len(s) for s in self.sets]
        self.whole = {n for n in self.bands if all(window_length(k) != n or (k == n and least * k > k - 1 + 1e-9) for k in sizes)}

    @staticmethod
    def _hash(h: np.ndarray, band: int) -> np.ndarray:
        # different multipliers order the (already mixed) shingles differently; the band's number is in the key
        return (h ^ _SALTS[band]) * (_SALTS[band] | np.uint64(1))

    def _retrieved(self, h: np.ndarray) -> set[tuple[int, int]]:
        """(first shingle of a window, template) for each collision of a band."""
        found: set[tuple[int, int]] = set()
        for band in range(BANDS):
            level, size = self._hash(h, band), 1
            for length, (keys, owner) in self.bands.items():
                if band and length in self.whole:
                    continue
                while size * 2 <= length:
                    level = np.minimum(level[: len(level) - size], level[size:]) if len(level) > size else level[:0]
                    size *= 2
                stride = max(1, length // 4)
                first = np.arange(0, max(len(h) - length, 0) + stride, stride)
                first = np.minimum(first, max(len(h) - length, 0))
                if len(h) < length:
                    least = np.array([self._hash(h, band).min()])
                    first = first[:1]
                else:
                    least = np.minimum(level[first], level[first + length - size])
                some = np.flatnonzero(self.maybe[length][(least & np.uint64(0xFFFF)).astype(np.int64)])
                least, first = least[some], first[some]
                at = np.minimum(np.searchsorted(keys, least), len(keys) - 1)
                for i in np.flatnonzero(keys[at] == least):
                    j = at[i]
                    while j < len(keys) and keys[j] == least[i]:
                        found.add((int(first[i]), int(owner[j])))
                        j += 1
        return found

    def scan(self, h: np.ndarray, doc: np.ndarray) -> dict[int, dict[str, float]]:
        """For each document with a match: licence and best containment. ``h`` are all shingles, in order of document."""
        found: dict[int, list[tuple[float, int, int, int, str]]] = {}
        if not len(h):
            return {}
        for first, t in self._retrieved(h):
            length = window_length(len(self.sets[t]))
            # windows may straddle documents; each document near the hit is verified by itself
            a, b = max(0, first - length), min(len(h), first + 2 * length)
            for d in distinct(doc[a:b]):
                own = np.flatnonzero(doc[a:b] == d) + a
                share = float(np.isin(self.sets[t], h[own]).mean())
                if share >= self.least:
                    at = own[np.isin(h[own], self.sets[t])]
                    found.setdefault(int(d), []).append((share, round(share * len(self.sets[t])), int(at[0]), int(at[-1]) + 1, self.names[t]))
        return {d: _nearest(hits) for d, hits in found.items()}


def _nearest(hits: list[tuple[float, int, int, int, str]]) -> dict[str, float]:
    """Licence and containment of the hits (containment, shingles, begin, end, licence) that no better one overlaps."""
    kept: list[tuple[float, int, int, int, str]] = []
    for hit in sorted(set(hits), key=lambda x: (-x[1], -x[0], x[2:])):
        if not any(x[2] < hit[3] and hit[2] < x[3] and (x[:2] != hit[:2] or x[4] == hit[4]) for x in kept):
            kept.append(hit)
    return {name: max(x[0] for x in kept if x[4] == name) for name in {x[4] for x in kept}}


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_licenses, licenses (sorted, comma-joined, null if none), containment (of the best, null if none)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_licenses", T.LongType()), T.StructField("licenses", T.StringType()), T.StructField("containment", T.DoubleType())])

    def run(batches):
        scanner = Scanner(templates, least)
        for batch in batches:
            for part in chunks(batch.column(1), lower=True, limit=1 << 20):
                w = part.words(NOT_ALNUM)
                at, h = w.windows(w.hashes(), WIDTH)
                found = scanner.scan(h, w.doc[at])
                rows = [found.get(i, {}) for i in range(part.n)]
                columns = [pa.array([len(r) for r in rows], pa.int64()), pa.array([",".join(sorted(r)) or None for r in rows], pa.string()), pa.array([max(r.values(), default=None) for r in rows], pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), *columns], names=schema.names)

    return map_arrow(docs.select(doc_id, text), run, schema)
