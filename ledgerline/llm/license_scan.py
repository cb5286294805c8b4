"""License scans: MinHash bands over overlapping text windows retrieve templates.

Windows of a template's number of shingles (SHINGLE words) begin at every word where one may
reach the threshold. BANDS bands of ROWS minima each: a window that holds a share c of a
template's shingles is as similar to it as J = c / (2 - c) or more, so at c = 0.75 all bands
miss with probability (1 - 0.6^ROWS)^BANDS = 6.3e-7. A retrieved template is verified by
exact containment: its distinct shingles that the window holds, over all it has.

Only windows that hold enough shingles of the templates of a size are hashed; with fewer,
three quarters of none of them are contained. Templates are a parameter of checked size and go to every task; texts are
scanned where they lie, with no shuffle but that of the few matches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.tables import table
from ledgerline.llm.words import Words, slices

SHINGLE, PERCENT = 5, 75
ROWS, BANDS = 2, 32
#: Words of all templates together, at most; they are sent to every task.
MAX_TEMPLATE_WORDS = 2_000_000
#: Windows hashed at once.
_CHUNK = 4096

_RNG = np.random.Generator(np.random.PCG64(11))
_FACTOR = _RNG.integers(0, 1 << 64, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 64, ROWS * BANDS, dtype=np.uint64)

#: Short notices by which texts state their license.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
]


_GNU = "This program is free software you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation either version {} of the License or at your option any later version"
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_PUBLIC = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_REST = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
#: (license, notice, marks: words that name the license, one of which a window must hold).
NOTICES: list[tuple[str, str, tuple[str, ...]]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache",)),
    ("Apache-2.0-short", "Licensed under the Apache License 2.0", ("apache",)),
    ("Apache-2.0-header", _APACHE, ()),
    ("Apache-2.0-full-header", f"{_APACHE} {_APACHE_REST}", ()),
    ("MIT", "Released under the MIT License", ("mit",)),
    ("MIT-terms", "under the terms of the MIT License", ("mit",)),
    ("MIT-licensed", "Licensed under the MIT License", ("mit",)),
    ("MIT-grant", _MIT[: _MIT.index(", and to permit")], ()),
    ("MIT-text", f"{_MIT} {_WARRANTY}", ()),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License", ("bsd",)),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License", ("bsd",)),
    ("BSD-grant", _BSD[: _BSD.index(": 1.")], ()),
    ("BSD-2-Clause-text", f"{_BSD} {_BSD_WARRANTY}", ()),
    ("BSD-3-Clause-text", f"{_BSD} {_BSD_3} {_BSD_WARRANTY}", ()),
    ("BSD-3-Clause-clause", _BSD_3[3:], ()),
    ("ISC", "Licensed under the ISC License", ("isc",)),
    ("ISC-grant", _ISC, ()),
    ("ISC-text", f"{_ISC} {_ISC_WARRANTY}", ()),
    *((name, f"This work is licensed under the GNU {title}, version {version}", ("gnu",)) for name, title, version in [("GPL-3.0", "General Public License", "3"), ("GPL-2.0", "General Public License", "2"), ("LGPL-3.0", "Lesser General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("AGPL-3.0", "Affero General Public License", "3")]),
    *((f"{name}-header", _GNU.format(title, version), ("gnu",)) for name, title, version in [("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3")]),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla", "mpl")),
    ("MPL-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/", ("mozilla", "mpl")),
    *((f"CC-{kind}-4.0", f"Licensed under CC {kind} 4.0", ("cc",)) for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")),
    *((f"CC-{kind}-4.0-name", f"This work is licensed under a Creative Commons {title} 4.0 International License", ("creative", "commons")) for kind, title in [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]),
    ("CC0-1.0", "Released under CC0 1.0 Universal", ("cc0",)),
    ("Unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered",)),
    ("Unlicense-text", _PUBLIC, ()),
]


def minima(shingles: np.ndarray) -> np.ndarray:
    """ROWS * BANDS minima of each row of shingle hashes."""
    out = np.empty((len(shingles), ROWS * BANDS), dtype=np.uint64)
    for j in range(ROWS * BANDS):
        out[:, j] = (shingles * _FACTOR[j] + _ADD[j]).min(axis=1)
    return out


class Index:
    """Templates by their distinct shingles and by their bands, for each number of shingles."""

    def __init__(self, templates: list[tuple[str, str]]) -> None:
        if sum(len(t.split()) for _, t in templates) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates hold more than {MAX_TEMPLATE_WORDS} words; they are sent to every task")
        self.names = [n for n, _ in templates]
        words = Words.of(pa.array([t for _, t in templates], pa.string()))
        hashes = words.hashes(lower=True)
        self.sets, self.bands = [], defaultdict(lambda: defaultdict(list))
        self.sizes: list[tuple[int, int]] = []  # (words a shingle, shingles) of each template
        for i, n in enumerate(words.counts().tolist()):
            k = min(SHINGLE, n)
            v, at = words.grams(hashes, k) if k else (np.empty(0, np.uint64), np.empty(0, np.int64))
            own = v[(at >= words.first[i]) & (at < words.first[i + 1])]
            self.sets.append(np.unique(own))
            self.sizes.append((k, len(own)))
            if k:
                for band, key in enumerate(self.keys(minima(own[None, :]))[0]):
                    self.bands[k, len(own)][band, key].append(i)
        self.shapes = sorted(set(s for s in self.sizes if s[0]))
        self.known = {k: np.unique(np.concatenate([s for s, z in zip(self.sets, self.sizes, strict=True) if z[0] == k])) for k in {k for k, _ in self.shapes}}
        self.bands = {k: dict(v) for k, v in self.bands.items()}

    @staticmethod
    def keys(mins: np.ndarray) -> list[list[bytes]]:
        raw = np.ascontiguousarray(mins.reshape(len(mins), BANDS, ROWS))
        return [[band.tobytes() for band in row] for row in raw]

    def scan(self, words: Words) -> dict[tuple[int, int], tuple[float, int, int]]:
        """Best (containment, -first word, windows) of each (document, template) of a slice."""
        hashes, docs = words.hashes(lower=True), words.doc()
        found: dict[tuple[int, int], list] = {}
        for k, n in self.shapes:
            v, at = words.grams(hashes, k)
            if not len(v):
                continue
            known = self.known[k]
            spot = np.minimum(np.searchsorted(known, v), len(known) - 1)
            hit = np.flatnonzero(known[spot] == v)
            starts = np.unique((hit[:, None] - np.arange(n)).ravel())
            starts = starts[starts >= 0]
            # A window's shingles are consecutive and of one document; a shorter rest of a document is a window too.
            ends = np.searchsorted(docs[at], np.arange(len(words.first) - 1), "right")
            begins = np.searchsorted(docs[at], np.arange(len(words.first) - 1), "left")
            owner = docs[at[starts]]
            starts = np.unique(np.maximum(np.minimum(starts, ends[owner] - n), begins[owner]))
            for a in range(0, len(starts), _CHUNK):
                part = starts[a : a + _CHUNK]
                owner = docs[at[part]]
                inside = np.minimum(part[:, None] + np.arange(n), ends[owner][:, None] - 1)
                windows = v[inside]
                for w, (row, doc, keys) in enumerate(zip(windows, owner.tolist(), self.keys(minima(windows)), strict=True)):
                    own = self.bands[k, n]
                    for i in {i for band, key in enumerate(keys) for i in own.get((band, key), ())}:
                        held = np.isin(self.sets[i], row).mean()
                        if 100 * held >= PERCENT:
                            first = int(at[part[w]] - words.first[doc])
                            found.setdefault((doc, i), []).append((float(held), -first))
        return {key: (*max(hits), len(hits)) for key, hits in found.items()}


def plain(texts: pa.Array) -> pa.Array:
    """Texts with runs of letters and digits as their words."""
    return pc.replace_substring_regex(texts.cast(pa.string()), r"[^\pL\pN]+", " ")


class NoticeIndex:
    """Notices of plain words; short ones have shingles of fewer words, so that an edit leaves three quarters."""

    def __init__(self, notices: list[tuple[str, str, tuple[str, ...]]]) -> None:
        if sum(len(t.split()) for _, t, _ in notices) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"notices hold more than {MAX_TEMPLATE_WORDS} words; they are sent to every task")
        self.names = [n for n, _, _ in notices]
        words = Words.of(plain(pa.array([t for _, t, _ in notices], pa.string())))
        hashes = words.hashes(lower=True)
        self.sets, self.sizes, self.bands = [], [], defaultdict(lambda: defaultdict(list))
        for i, n in enumerate(words.counts().tolist()):
            k = max(1, min(SHINGLE, (n + 1) // 5)) if n else 0
            v, at = words.grams(hashes, k) if k else (np.empty(0, np.uint64), np.empty(0, np.int64))
            own = v[(at >= words.first[i]) & (at < words.first[i + 1])]
            self.sets.append(np.unique(own))
            self.sizes.append((k, len(own)))
            for band, key in enumerate(Index.keys(minima(own[None, :]))[0]) if k else ():
                self.bands[k, len(own)][band, key].append(i)
        self.bands = {shape: dict(v) for shape, v in self.bands.items()}
        marks = [Words.of(pa.array([" ".join(m)], pa.string())).hashes(lower=True) for _, _, m in notices]
        self.marks = [m if len(m) else None for m in marks]
        self.shapes = []
        for k, n in sorted(set(z for z in self.sizes if z[0])):
            own = [s for s, z in zip(self.sets, self.sizes, strict=True) if z == (k, n)]
            self.shapes.append((k, n, np.unique(np.concatenate(own)), min(-(-PERCENT * len(s) // 100) for s in own)))

    def scan(self, words: Words) -> dict[tuple[int, int], tuple[float, int, int]]:
        """Best (containment, -first word, windows) of each (document, notice) of a slice, without what a better notice at the same place beats."""
        hashes, docs = words.hashes(lower=True), words.doc()
        grams = {k: words.grams(hashes, k) for k in {k for k, *_ in self.shapes}}
        found: dict[int, list[tuple]] = defaultdict(list)
        for k, n, known, least in self.shapes:
            v, at = grams[k]
            if not len(v):
                continue
            # Windows without ``least`` shingles of this shape's notices hold three quarters of none of them.
            spot = np.minimum(np.searchsorted(known, v), len(known) - 1)
            seen = np.r_[0, np.cumsum(known[spot] == v)]
            end = np.searchsorted(docs[at], docs[at], "right")
            begin = np.searchsorted(docs[at], docs[at], "left")
            place = np.arange(len(v))
            till = np.minimum(place + n, end)
            starts = np.flatnonzero((seen[till] - seen[place] >= least) & (place <= np.maximum(end - n, begin)))
            for a in range(0, len(starts), _CHUNK):
                part = starts[a : a + _CHUNK]
                windows = v[np.minimum(part[:, None] + np.arange(n), till[part][:, None] - 1)]
                own = self.bands[k, n]
                for w, keys in enumerate(Index.keys(minima(windows))):
                    for i in sorted({i for band, key in enumerate(keys) for i in own.get((band, key), ())}):
                        held = float(np.isin(self.sets[i], windows[w]).mean())
                        first, last = int(at[part[w]]), int(at[till[part[w]] - 1]) + k
                        if 100 * held >= PERCENT and (self.marks[i] is None or np.isin(self.marks[i], hashes[first:last]).any()):
                            doc = int(docs[first])
                            found[doc].append((-held, -len(self.sets[i]), i, first - int(words.first[doc]), last - int(words.first[doc])))
        out: dict[tuple[int, int], list] = {}
        counts = words.counts()
        for doc, hits in found.items():
            owner = np.full(int(counts[doc]), -1)
            for held, _, i, first, last in sorted(hits):
                if np.isin(owner[first:last], (-1, i)).all():
                    owner[first:last] = i
                    out.setdefault((doc, i), []).append((-held, -first))
        return {key: (*max(hits), len(hits)) for key, hits in out.items()}


def scan_notices(docs: DataFrame, notices: list[tuple[str, str, tuple[str, ...]]]) -> DataFrame:
    """(doc_id, license, containment, first_word, n_windows): as ``scan``, over runs of letters and digits as words.

    A notice has shingles of a fifth of its words, at most SHINGLE. A window must hold one of the
    notice's marks, if it has any: "Released under the BSD License" holds 0.8 of the notice that
    names MIT. Windows of different notices that share words are told apart by the greater
    containment, then the larger notice, then the order of the list; only the best is a match.
    Nulls, repeats, short texts, empty tables and other columns are taken as by ``scan``.
    """
    return _scan(docs, NoticeIndex(notices), plain)


def scan(docs: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, license, containment, first_word, n_windows): templates that a text holds.

    One row for each document and template with a window at PERCENT or more: the greatest
    share, the first word (from 0) of the first window that has it, and how many windows reach
    the threshold. Templates of fewer than five words are one shingle, those without words
    match nothing; texts shorter than a template are one window. Null and empty texts match
    nothing; repeated rows give their rows again; a null doc_id is kept; an empty table gives
    no rows; other columns are ignored.
    """
    return _scan(docs, Index(templates), lambda texts: texts)


def _scan(docs: DataFrame, index: Index | NoticeIndex, read: Callable[[pa.Array], pa.Array]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = "doc_id long, license string, containment double, first_word long, n_windows long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[d], index.names[i], held, -back, n) for (d, i), (held, back, n) in index.scan(Words.of(read(batch.column("text")))).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "license", "containment", "first_word", "n_windows"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return scan_notices(table(spark, sf_dir, "documents"), NOTICES)


QUERIES = {"op8_license_scan": op8_license_scan}
ORACLES: dict[str, str] = {}
