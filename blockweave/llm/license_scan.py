"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Words are lowered runs of letters and digits. Each template's k-grams are winnowed: of every
``WINDOW`` neighbouring hashes the smallest is kept, so any run of ``K + WINDOW - 1`` words that
a text shares with a template holds a kept one. An inverted index (hash to template and place)
is looked up with all k-grams of a text at once. Hits of a template on neighbouring diagonals
form a candidate, and the template is aligned with the words around it in a band. Reported are
the share of template words that match, in order, and the span of the text they cover.
Long templates are whole texts, so both speak of whole licenses; texts that stop where a
license's first part does are found under a name of their own (``-beginning``).

Texts are read whole, in one pass without a shuffle. The index is as small as the templates.

Defined results: null and empty texts have no findings. Of findings that overlap by more than
half, the one with more matching words stays (then higher coverage, then the name). Rows are
scanned one by one, repeated or not; a null id is an id like another. An empty table gives no
rows. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.shingles import Runs, folding, mixed, slices
from blockweave.runtime import few_bytes

K, WINDOW = 3, 2
#: Least share of a template's words that must match.
COVERAGE = 0.8
#: Words of text inserted or left out that an alignment may drift by, besides a tenth of the template.
BAND = 4

#: Whole license texts and notices as published, by SPDX-like names. Titles, copyright lines and the places to fill in are left out.
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS "
    "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
    "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
APACHE_2 = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You "
    "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
    "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
    "either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
GPL_3 = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
    "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
    "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public "
    "License along with this program. If not, see <https://www.gnu.org/licenses/>."
)
BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _until(text: str, end: str) -> str:
    return text[: text.index(end) + len(end)]


TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT": MIT,
    "ISC": ISC,
    "Apache-2.0": APACHE_2,
    "GPL-3.0-or-later": GPL_3,
    "BSD-2-Clause": f"{BSD_TERMS} {BSD_DISCLAIMER}",
    "BSD-3-Clause": f"{BSD_TERMS} {BSD_NAMES} {BSD_DISCLAIMER}",
    # a text that ends early is named so; in a whole one the whole license matches more words and stays
    "MIT-beginning": _until(MIT, "NONINFRINGEMENT."),
    "ISC-beginning": _until(ISC, "in all copies."),
    "Apache-2.0-beginning": _until(APACHE_2, "express or implied."),
    "GPL-3.0-or-later-beginning": _until(GPL_3, "any later version."),
    "BSD-beginning": BSD_TERMS,
}

FINDING = "doc_id long, license string, coverage double, matched int, span_start long, span_end long"


def _word_runs(data: np.ndarray, offsets: np.ndarray) -> Runs:
    code = np.arange(256)
    word = (code >= 128) | (code >= 48) & (code <= 57) | ((code | 32) >= 97) & ((code | 32) <= 122) & (code < 128)
    return Runs(data, offsets, word[data], folding()[0])


def words_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return _word_runs(data, np.array([0, len(data)])).hashes() if len(data) else np.empty(0, np.uint64)


def grams(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all k neighbouring words."""
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
    return mixed(out)


def winnow(h: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the smallest hash of every window, the rightmost of equal ones."""
    if len(h) <= window:
        return [int(len(h) - 1 - h[::-1].argmin())] if len(h) else []
    return sorted({i + window - 1 - int(h[i : i + window][::-1].argmin()) for i in range(len(h) - window + 1)})


class Finding(NamedTuple):
    license: str
    coverage: float
    matched: int
    first: int
    last: int


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> list[tuple[int, int]]:
    """Most in-order matches (template word, text word) with text word - template word within ``band`` of ``shift``.

    Of alignments with as many matches, one that spans the fewest words of text.
    """
    width = 2 * band + 1
    nothing = (0, -1, None)  # matches, first word of text (later is better), path
    before = [nothing] * (width + 1)  # cell b: text words up to i + shift - band + b
    best, least = nothing, 0
    words = text.tolist()
    for i, word in enumerate(template.tolist()):
        row = [nothing] * (width + 1)
        left = nothing
        for b in range(width):
            j = i + shift - band + b
            cell = max(before[b + 1], left, key=lambda c: c[:2])
            if 0 <= j < len(words) and words[j] == word:
                count, first, path = before[b]
                first = first if path else j
                if (count + 1, first) > cell[:2]:
                    cell = (count + 1, first, ((i, j), path))
                    if (count + 1, first - j) > (best[0], least):
                        best, least = cell, first - j
            row[b] = left = cell
        before = row
    found, path = [], best[2]
    while path:
        found.append(path[0])
        path = path[1]
    return found[::-1]


class Index:
    """Inverted index of winnowed template fingerprints."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.templates = {name: words_of(text) for name, text in templates.items()}
        places = defaultdict(list)
        self.kept = {}
        for name, h in self.templates.items():
            if len(h) < K:
                raise ValueError(f"template {name} has fewer than {K} words")
            g = grams(h)
            self.kept[name] = winnow(g)
            for i in self.kept[name]:
                places[int(g[i])].append((name, i))
        self.places = dict(places)
        self.known = np.array(sorted(self.places), np.uint64)

    def hits(self, g: np.ndarray) -> np.ndarray:
        """Places of a text's k-grams that the index knows."""
        if not len(self.known) or not len(g):
            return np.empty(0, np.int64)
        return np.flatnonzero(self.known[np.minimum(np.searchsorted(self.known, g), len(self.known) - 1)] == g)

    def findings(self, h: np.ndarray, g: np.ndarray, at: np.ndarray, coverage: float = COVERAGE) -> list[Finding]:
        """Findings in a text with words ``h``, k-grams ``g`` and hits ``at``."""
        diagonals = defaultdict(list)
        for p in at.tolist():
            for name, i in self.places[int(g[p])]:
                diagonals[name].append(p - i)
        found = []
        for name, ds in diagonals.items():
            template = self.templates[name]
            band = BAND + len(template) // 10
            ds.sort()
            groups = [[ds[0]]]
            for d in ds[1:]:  # a group never spans more than the band
                if d - groups[-1][0] <= band:
                    groups[-1].append(d)
                else:
                    groups.append([d])
            for group in groups:
                shift = group[len(group) // 2]
                near = h[max(0, shift - band) : max(0, shift + len(template) + band)]
                if np.isin(template, near).sum() < coverage * len(template):  # no alignment can match more
                    continue
                pairs = align(template, h, shift, band)
                if pairs and len(pairs) >= coverage * len(template):
                    found.append(Finding(name, len(pairs) / len(template), len(pairs), pairs[0][1], pairs[-1][1]))
        found.sort(key=lambda f: (-f.matched, -f.coverage, f.license, f.first))
        kept: list[Finding] = []
        taken: list[tuple[int, int]] = []  # spans kept so far, in order
        longest = max((f.last - f.first for f in found), default=0)
        for f in found:
            near = taken[bisect_left(taken, (f.first - longest,)) : bisect_right(taken, (f.last + 1,))]
            if all(2 * (min(f.last, b) - max(f.first, a) + 1) <= f.last - f.first + 1 for a, b in near):
                kept.append(f)
                insort(taken, (f.first, f.last))
        return sorted(kept, key=lambda f: f.first)


#: Bytes of a table of templates, which every task holds, at most.
TEMPLATE_BYTES = 8 << 20


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame = TEMPLATES, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FINDING rows; spans are in characters of the text, the end behind the last. ``templates`` may be a table (name, text) of at most TEMPLATE_BYTES."""
    if isinstance(templates, DataFrame):
        if not few_bytes(templates, TEMPLATE_BYTES):
            raise ValueError(f"templates take over {TEMPLATE_BYTES} bytes")
        templates = {r["name"]: r["text"] for r in templates.select("name", "text").collect()}
    index = Index(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, data, offsets in slices(batch.column(1)):
                if not len(data):
                    continue
                ids = batch.column(0).slice(at).to_pylist()
                runs = _word_runs(data, offsets)
                h, before = runs.hashes(), runs.before
                g = grams(h)
                hits = index.hits(g)
                owner = np.searchsorted(before, hits, side="right") - 1
                rows = []
                for i in np.unique(owner).tolist():
                    a, b = int(before[i]), int(before[i + 1])
                    own = hits[(owner == i) & (hits <= b - K)] - a  # a k-gram must not reach into the next text
                    text = data[offsets[i] : offsets[i + 1]]
                    for f in index.findings(h[a:b], g[a:b], own, coverage) if len(own) else ():
                        start, end = (int(x) - int(offsets[i]) for x in (runs.starts[a + f.first], runs.ends[a + f.last]))
                        chars = [int(((text[:x] & 0xC0) != 0x80).sum()) for x in (start, end)]
                        rows.append((ids[i], f.license, f.coverage, f.matched, *chars))
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in FINDING.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, FINDING)
