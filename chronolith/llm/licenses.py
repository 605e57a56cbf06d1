"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Words are runs of digits, letters and non-ASCII characters with A-Z lowered; shingles are five
words (a shorter template or text: all its words).  A template of n shingles belongs to the size class
C, the least power of two not below n.  Each class cuts a document's shingles into blocks of C and takes
every two neighbouring blocks as a window, so that any n consecutive shingles lie whole in a
window.  ``BANDS`` bands of one MinHash row each compare windows and templates.

The band settings' guarantee: if a window holds a share c >= 0.8 of a template's n > C / 2
shingles, their Jaccard similarity is at least c n / (2 C + (1 - c) n) >= 0.19, so that at least one of
40 bands collides with probability 1 - (1 - 0.19) ** 40 > 0.9997.  Whatever collides is
verified: the share of the template's shingles that the window holds, on their 64-bit hashes.

Templates are a library of bounded size (``MOST_BYTES``, checked) and go to every task.
Defined results: null and empty texts match nothing; a document gives one row for each template that it
matches, with its best window (ties: the first); rows that repeat an id are scanned each; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_arrays import U64, chunks, mix64, word_hashes

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 40
MOST_BYTES = 16 << 20

# Public licence notices.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
}

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def _words(raw, off):
    word, n = _WORD[raw], len(raw)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(word & (~np.concatenate(([False], word[:-1])) | edge[:n])) if n else np.zeros(0, np.int64)
    ends = np.flatnonzero(word & (~np.concatenate((word[1:], [False])) | edge[1:])) + 1 if n else starts
    return starts, ends, np.searchsorted(starts, off)


def shingles(raw: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each shingle, offsets of the documents in them)."""
    starts, ends, first = _words(raw, off)
    h = word_hashes(_LOW[raw], starts, ends)
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out = np.concatenate(([0], np.cumsum(n)))
    begin = np.repeat(first[:-1] - out[:-1], n) + np.arange(out[-1])
    end = np.minimum(begin + size, np.repeat(first[1:], n)) if len(begin) else begin
    got = np.zeros(len(begin), U64)
    for i in range(size):
        at = np.minimum(begin + i, len(h) - 1) if len(h) else begin
        got = np.where(begin + i < end, mix64(got + h[at] + U64(i + 1)), got) if len(h) else got
    return got, out


_A = mix64(np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def _values(h: np.ndarray, band: int) -> np.ndarray:
    x = h * _A[band]
    return ((x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9) >> U64(32)).astype(np.uint32)


class Library:
    """Templates by size class, with their MinHash values for each band."""

    def __init__(self, templates: dict[str, str]):
        assert sum(len(x.encode()) for x in templates.values()) <= MOST_BYTES, "too many templates to send to every task"
        self.names = sorted(templates)
        self.sets, self.classes = [], {}
        for i, name in enumerate(self.names):
            raw = np.frombuffer(templates[name].encode(), np.uint8)
            held = np.unique(shingles(raw, np.array([0, len(raw)]))[0])
            self.sets.append(held)
            if len(held):
                self.classes.setdefault(1 << int(len(held) - 1).bit_length(), []).append(i)
        self.values = {c: [np.array([_values(self.sets[i], band).min() for i in of]) for band in range(BANDS)] for c, of in self.classes.items()}
        self.tables = {}
        for c, of in self.values.items():
            table = np.zeros((BANDS, 1 << 16), bool)
            for band, v in enumerate(of):
                table[band, v & 0xFFFF] = True
            self.tables[c] = table

    def scan(self, h: np.ndarray, out: np.ndarray, banded: bool = True):
        """Yields (document, template, containment, first and last shingle that match) of verified windows."""
        size = np.diff(out)
        plans = []
        for c, of in self.classes.items():
            blocks = -(-size // c)
            first = np.concatenate(([0], np.cumsum(blocks)))
            begin = np.repeat(out[:-1], blocks) + c * (np.arange(first[-1]) - np.repeat(first[:-1], blocks))
            last = np.zeros(first[-1], bool)
            last[first[1:][blocks > 0] - 1] = True
            plans.append((c, of, begin, last, np.repeat(np.arange(len(size)), blocks), set()))
        for band in range(BANDS if banded and len(h) else 0):
            v = _values(h, band)
            for c, of, begin, last, _, found in plans:
                low = np.minimum.reduceat(v, begin) if c > 1 else v
                low = np.minimum(low, np.where(last, low, np.concatenate((low[1:], low[-1:]))))
                hit = np.flatnonzero(self.tables[c][band][low & 0xFFFF])
                for j, value in enumerate(self.values[c][band] if len(hit) else ()):
                    found.update((w, of[j]) for w in hit[low[hit] == value].tolist())
        for c, of, begin, _, doc, found in plans:
            for w, t in sorted(found) if banded else ((w, t) for w in range(len(begin)) for t in of):
                a, b = begin[w], min(begin[w] + 2 * c, out[doc[w] + 1])
                match = np.isin(h[a:b], self.sets[t])
                share = len(np.unique(h[a:b][match])) / len(self.sets[t])
                if share >= CONTAINMENT:
                    places = np.flatnonzero(match) + a - out[doc[w]]
                    yield int(doc[w]), t, share, int(places[0]), int(places[-1])


def scan_licenses(documents: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, containment, start_word, end_word) of each template that a document holds."""
    texts = dict(NOTICES if templates is None else templates)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        library = Library(texts)
        for b in batches:
            rows, best = [], {}
            for row, _, raw, off in chunks(b.column(1)):
                h, out = shingles(raw, off)
                for doc, t, share, first, last in library.scan(h, out):
                    key = (row + doc, t)
                    if key not in best or (-share, first) < (-best[key][0], best[key][1]):
                        best[key] = (share, first, last)
            rows = sorted(best)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([d for d, _ in rows], pa.int64())), pa.array([library.names[t] for _, t in rows], pa.string()), pa.array([best[x][0] for x in rows], pa.float64()), pa.array([best[x][1] for x in rows], pa.int64()), pa.array([best[x][2] + SHINGLE for x in rows], pa.int64())],
                ["id", "license", "containment", "start_word", "end_word"],
            )

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, license string, containment double, start_word long, end_word long").withColumnRenamed("id", id_col)
