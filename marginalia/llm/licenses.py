"""License scan: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment measures them.

A text and every template are sequences of lower-cased words of letters and digits. Of each ``WINDOW`` neighbouring hashes of
``GRAM`` words the smallest is a fingerprint, so any GRAM + WINDOW - 1 words that a text shares with a template share
one. Fingerprints that meet in the index propose (template, place); where enough of the template's words stand within ``BAND`` of that diagonal for
the coverage wanted, word alignment in that band gives the matched words, from which come ``coverage`` (matched words by the template's words) and the span (code points
of the text, end exclusive). Templates too short for that promise are looked up at every hash instead. A finding whose text has other words that tell licenses
apart (``TELLING``) than its template is dropped. Of findings that overlap, whatever their templates, the one with more matched words stays.

Templates are a fixed list (some kilobytes), sent to every task. One pass without a shuffle. Null and empty texts, and an
empty table, give no rows; repeated rows give repeated findings; a null doc_id stays null.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from marginalia.llm.tables import take_columns, tidy

GRAM, WINDOW, BAND = 3, 2, 12
TOKEN = re.compile(r"[^\W_]+")

#: Public license texts and notices, as they are commonly written.
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_NO_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_NO_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_NO_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_GNU = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
_CC = {"": "", "-SA": "-ShareAlike", "-NC": "-NonCommercial", "-ND": "-NoDerivatives", "-NC-SA": "-NonCommercial-ShareAlike", "-NC-ND": "-NonCommercial-NoDerivatives"}
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1-line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-line": "Use of this source code is governed by a BSD-style license.",
    **{f"CC-BY{k}-4.0-line": f"This work is licensed under a Creative Commons Attribution{v} 4.0 International License." for k, v in _CC.items()},
    **{f"CC-BY{k}-4.0-short": f"Licensed under CC BY{k} 4.0." for k in _CC},
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "MIT": f"{_MIT} {_MIT_NO_WARRANTY}",
    "MIT-grant": _MIT,
    "ISC": f"{_ISC} {_ISC_NO_WARRANTY}",
    "ISC-grant": _ISC,
    "BSD-3-Clause": f"{_BSD} {_BSD_NAME} {_BSD_NO_WARRANTY}",
    "BSD-3-Clause-grant": f"{_BSD} {_BSD_NAME}",
    "BSD-2-Clause": f"{_BSD} {_BSD_NO_WARRANTY}",
    "BSD-2-Clause-grant": _BSD,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "Unlicense": f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_MIT_NO_WARRANTY}",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": _GNU.format(what="program", name="General Public License", n="3"),
    "GPL-2.0": _GNU.format(what="program", name="General Public License", n="2"),
    "LGPL-3.0": _GNU.format(what="library", name="Lesser General Public License", n="3"),
    "LGPL-2.1": _GNU.format(what="library", name="Lesser General Public License", n="2.1"),
    "AGPL-3.0": _GNU.format(what="program", name="Affero General Public License", n="3"),
    "All-rights-reserved": "All rights reserved.",
}
#: Words that make another license of a text: a match whose text has one more or one fewer than the template is none. In notices of fewer than SHORT words numbers count too.
TELLING = {"lesser", "affero", "noncommercial", "noderivatives", "noderivs", "sharealike", "nc", "nd", "sa"}
SHORT = 30


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def gram_hashes(h: np.ndarray, gram: int = GRAM) -> np.ndarray:
    out = np.zeros(max(0, len(h) - gram + 1), np.uint64)
    for k in range(gram if len(out) else 0):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ h[k : k + len(out)]
        out ^= out >> np.uint64(29)
    return out


def winnow(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest hash (the last of equals) of each window."""
    if len(grams) <= window:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1))


class Index:
    """Fingerprint: the (template, place) that have it."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.words = {k: [w.lower() for w in TOKEN.findall(t)] for k, t in templates.items()}
        self.vocabulary = {w for words in self.words.values() for w in words}
        hashes = WordHashes()
        self.postings: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for name, words in self.words.items():
            grams = gram_hashes(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
            for at in winnow(grams):
                self.postings[int(grams[at])].append((name, int(at)))
        short = [k for k, spots in self.postings.items() if any(len(self.words[name]) < GRAM + WINDOW - 1 for name, _ in spots)]
        self.keys, self.short = (np.sort(np.fromiter(x, np.uint64, len(x))) for x in (self.postings, short))


def align(template: list[str], words: list[str], shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched, first, end) of the best local word alignment with word j of the text near word j - shift of the template.

    A match scores 1, a word left out or exchanged -0.5; the matched words and the ends belong to the best score.
    """
    best = (0.0, 0, 0, 0)
    above: dict[int, tuple[float, int, int]] = {}
    for i, want in enumerate(template):
        row: dict[int, tuple[float, int, int]] = {}
        for j in range(max(0, i + shift - band), min(len(words), i + shift + band + 1)):
            score, matched, start = max((0.0, 0, j), above.get(j - 1, (0.0, 0, j)), key=lambda x: x[0])
            if words[j] == want:
                cell = (score + 1, matched + 1, start)
            else:
                options = [(score - 0.5, matched, start)]
                if j in above:
                    options.append((above[j][0] - 0.5, *above[j][1:]))
                if j - 1 in row:
                    options.append((row[j - 1][0] - 0.5, *row[j - 1][1:]))
                cell = max(options, key=lambda x: x[0])
            if cell[0] > 0:
                row[j] = cell
                if cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], j + 1)
        above = row
    return best[1:]


def most_matched(template: list[str], places: dict[str, np.ndarray], shifts: np.ndarray, band: int = BAND) -> np.ndarray:
    """For each shift, how many words of the template stand in the text at all within the band: no alignment there can match more. places: of each word of the text."""
    most = np.zeros(len(shifts), np.int64)
    for i, want in enumerate(template):
        own = places.get(want)
        if own is not None:
            most += np.searchsorted(own, shifts + i + band, "right") > np.searchsorted(own, shifts + i - band, "left")
    return most


def telling(words: list[str], length: int | None = None) -> set[str]:
    """The words among these that tell one license from another; length is that of the template."""
    short = (len(words) if length is None else length) < SHORT
    return {w for w in words if w in TELLING or (short and w.isdigit())}


def _places(words: list[str], wanted: set[str]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        if w in wanted:
            out[w].append(i)
    return out


def findings(text: str, index: Index, known: WordHashes, min_coverage: float) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched words, start, end) by start."""
    words = [w.lower() for w in TOKEN.findall(text)]
    if len(words) < GRAM:
        return []
    grams = gram_hashes(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    spots = winnow(grams)
    at = np.minimum(np.searchsorted(index.keys, grams[spots]), len(index.keys) - 1)
    hits = np.union1d(spots[index.keys[at] == grams[spots]], np.flatnonzero(np.isin(grams, index.short)))
    if not len(hits):
        return []
    # A place for each template and band of diagonals; only those where enough words stand at all are aligned.
    tried: dict[str, dict[int, int]] = defaultdict(dict)
    for hit in hits.tolist():
        for name, place in index.postings[int(grams[hit])]:
            tried[name].setdefault((hit - place) // BAND, hit - place)
    places = {w: np.array(at) for w, at in _places(words, index.vocabulary).items()}
    found: list[tuple[float, int, str, int, int]] = []
    for name, bands in tried.items():
        template = index.words[name]
        shifts = np.fromiter(bands.values(), np.int64, len(bands))
        enough = most_matched(template, places, shifts) >= min_coverage * len(template)
        for shift in shifts[enough].tolist():
            matched, first, end = align(template, words, shift)
            coverage = matched / len(template)
            if coverage >= min_coverage and telling(template) == telling(words[first:end], len(template)):
                found.append((coverage, matched, name, first, end))
    if not found:
        return []
    edges = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    out: list[tuple[str, float, int, int, int]] = []
    taken: list[tuple[int, int]] = []
    for coverage, matched, name, first, end in sorted(found, key=lambda x: (-x[1], -x[0], x[3], x[2])):
        if all(end <= a or first >= b for a, b in taken):
            taken.append((first, end))
            out.append((name, round(coverage, 6), matched, edges[first][0], edges[end - 1][1]))
    return sorted(out, key=lambda x: (x[3], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = 0.75) -> DataFrame:
    """Rows (doc_id, license, coverage, matched_words, start, end): every place where a template is matched well enough."""
    index = Index(templates or TEMPLATES)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            rows = [(doc, *f) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for f in findings(text, index, known, min_coverage)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "license", "coverage", "matched_words", "start", "end"])

    return take_columns(docs, "doc_id", "text").mapInArrow(tidy(look), "doc_id long, license string, coverage double, matched_words long, start long, end long")
