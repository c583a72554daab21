"""License scans: winnowed fingerprints of templates pick candidates, a banded alignment tells coverage and span."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import HASH_BASE, HASH_MIX, hashed_words, map_batches, mixed, plain_bytes, slices

GRAM = 3
WINDOW = 2
BAND = 8
MIN_COVERAGE = 0.8

# Published license notices and whole short licenses, as they are worded.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("Apache-2.0", "apache-line", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "apache-notice", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
for the specific language governing permissions and limitations under the License."""),
    ("MIT", "mit-line", "Released under the MIT License"),
    ("MIT", "mit-permission", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software."""),
    ("GPL-3.0", "gpl3-line", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "gpl3-notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but
WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""),
    ("BSD", "bsd-conditions", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""),
    ("MPL-2.0", "mpl-notice", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You
can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("CC-BY-NC-4.0", "cc-by-nc-line", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "cc-by-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "cc-by-sa-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "cc0-notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("MIT", "mit-full", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", "bsd-2-full", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", "bsd-3-full", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", "isc-full", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN
NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", "zlib-full", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", "unlicense-full", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We
make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
)


def fingerprints(words: np.ndarray, owner: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word position) of the winnowed grams: the smallest of every ``window`` consecutive ones, per text.

    Two texts that share ``gram + window - 1`` words in a row share a fingerprint. A text with fewer grams than a window keeps its smallest.
    """
    n = len(words) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words[:n].copy()
    for k in range(1, gram):
        h = mixed(h * np.uint64(HASH_BASE) + words[k : n + k] + np.uint64(k * int(HASH_MIX) % 2**64))
    at = np.flatnonzero(owner[:n] == owner[gram - 1 :])
    h, text = h[at], owner[at]
    keep = np.zeros(len(h), bool)
    counts = np.bincount(text, minlength=int(text.max()) + 1 if len(text) else 0)
    m = len(h) - window + 1
    if m > 0:
        whole = np.flatnonzero(text[:m] == text[window - 1 :])
        block = np.stack([h[whole + k] for k in range(window)], axis=1)
        # Of equal smallest ones the last counts.
        keep[whole + window - 1 - block[:, ::-1].argmin(axis=1)] = True
    for t in np.flatnonzero((counts > 0) & (counts < window)):
        own = np.flatnonzero(text == t)
        keep[own[h[own].argmin()]] = True
    return h[keep], at[keep]


def template_index(templates=TEMPLATES) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Inverted index, sorted by hash: (hash, template, word position), and the hashed words of each template."""
    words, owner, bounds, _, _ = hashed_words([t[2] for t in templates])
    h, at = fingerprints(words, owner)
    order = np.argsort(h, kind="stable")
    return h[order], owner[at][order], (at - bounds[owner[at]])[order], [words[a:b] for a, b in zip(bounds, bounds[1:])]


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Longest common subsequence of words near the diagonal: (matched words, first, last matched position in ``text``).

    Template word q may meet text words q + shift - band to q + shift + band. Among equal results the shortest span counts.
    """
    width = 2 * band + 1
    low = -(10**9)
    # Per cell of the band: (matched, start) of the best path that ends there.
    score, start = np.zeros(width, np.int64), np.full(width, low)
    best = (0, 0, -1)
    for q in range(len(template)):
        base = q + shift - band
        # Moving to the next word of the template, the same text position lies one cell to the left.
        above, above_start = np.append(score[1:], 0), np.append(start[1:], low)
        fresh, fresh_start = above.copy(), above_start.copy()
        for j in range(width):
            p = base + j
            if 0 <= p < len(text) and text[p] == template[q]:
                one = score[j] + 1
                begin = start[j] if score[j] else p
                if (one, begin) > (fresh[j], fresh_start[j]):
                    fresh[j], fresh_start[j] = one, begin
                    if (one, begin - p) > (best[0], best[1] - best[2]):
                        best = (int(one), int(begin), p)
            if j and (fresh[j - 1], fresh_start[j - 1]) > (fresh[j], fresh_start[j]):
                fresh[j], fresh_start[j] = fresh[j - 1], fresh_start[j - 1]
        score, start = fresh, fresh_start
    return best


def _matches(text: np.ndarray, index, band: int, least: float) -> list[tuple[int, int, int, int, bool]]:
    """(template, matched, first, last, best) in the hashed words of one text; overlapping finds of one template are one.

    A find is the best where it stands if no overlapping find of any template matches more words, the first template of equals.
    """
    hashes, owners, places, templates = index
    h, at = fingerprints(text, np.zeros(len(text), np.int64))
    lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
    hits: dict[int, list[tuple[int, int]]] = {}
    for i in np.flatnonzero(hi > lo).tolist():
        for k in range(lo[i], hi[i]):
            hits.setdefault(int(owners[k]), []).append((int(at[i]) - int(places[k]), int(at[i])))
    found = []
    for t, pairs in hits.items():
        done: list[tuple[int, int, int]] = []
        before = None
        for shift, _ in sorted(pairs):
            if before is not None and shift - before <= band // 2:
                continue
            before = shift
            first = max(0, shift - band)
            matched, a, b = align(templates[t], text[first : shift + len(templates[t]) + band], shift - first, band)
            if matched < least * len(templates[t]):
                continue
            a, b = a + first, b + first
            clash = [x for x in done if x[1] <= b and a <= x[2]]
            if all(x[0] < matched for x in clash):
                done = [x for x in done if x not in clash] + [(matched, a, b)]
        found += [(t, m, a, b) for m, a, b in done]
    best = lambda x: not any(y is not x and y[2] <= x[3] and x[2] <= y[3] and (-y[1], y[0]) < (-x[1], x[0]) for y in found)
    return sorted(((*x, best(x)) for x in found), key=lambda x: (x[2], x[0]))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, band: int = BAND, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per find: ``doc_id, license, template, n_template, n_matched, coverage, first_word, last_word, start, stop, best``.

    ``best`` is false where an overlapping find matches more words, as a notice does inside its whole license. Words are compared in lower case without marks. ``start`` and ``stop`` count characters of the text where lower case keeps
    lengths. Whole texts are scanned; null and empty texts, and texts without a find, give no row. Repeated rows give their finds each.
    """

    def run(c: dict[str, list]) -> dict:
        index = template_index(templates)
        out: dict[str, list] = {k: [] for k in ("doc_id", "license", "template", "n_template", "n_matched", "coverage", "first_word", "last_word", "start", "stop", "best")}
        texts = [t or "" for t in c["text"]]
        for lo, hi in slices([len(t) for t in texts]):
            words, owner, bounds, start, stop = hashed_words(texts[lo:hi])
            if not len(words):
                continue
            h, at = fingerprints(words, owner)
            for i in np.unique(owner[at[np.isin(h, index[0])]]).tolist():
                a, b = bounds[i], bounds[i + 1]
                raw = plain_bytes(texts[lo + i])
                for t, matched, first, last, best in _matches(words[a:b], index, band, min_coverage):
                    n = len(index[3][t])
                    chars = [len(raw[:x].decode("utf-8", "replace")) for x in (int(start[a + first]), int(stop[a + last]))]
                    for name, value in zip(out, (c["doc_id"][lo + i], templates[t][0], templates[t][1], n, matched, matched / n, first, last, *chars, best)):
                        out[name].append(value)
        return out

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(chosen, run, "doc_id long, license string, template string, n_template int, n_matched int, coverage double, first_word int, last_word int, start int, stop int, best boolean")
