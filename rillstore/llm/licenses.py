"""License scan: Dice coefficient of word bigrams against licence templates.

The templates are notices, headers and short licences (`TEMPLATES`) and the whole texts in the folder license_texts. Lines, and runs of consecutive lines, are normalised (lower case, words of letters, digits, dots) and compared with each
template: 2 * |common bigrams| / (|bigrams| + |template's bigrams|), with multiplicity. A coefficient of `DICE` or
more is only possible if the sizes lie within a factor of (2 - DICE) / DICE, and if a bigram is shared; both bounds
prune templates and runs without loss: a text with fewer words than a match of a template needs, or with fewer bigrams in
common with it, is not compared with it. Runs are grown around lines that share a bigram with a template. Notices that share
their lines with other words are found as windows of words, from any shared bigram to any other; a window gives way to a
run or window of its own template, and to a closer match of another that it overlaps and that is not shorter.

Defined cases: null and empty texts match nothing; a text's equal lines are reported each; when several runs around the
same lines match one template the best one counts, then the first, then the shortest; repeated rows give repeated
results; a text of any length is scanned whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from importlib import resources
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import map_slices

#: The least coefficient of a match; bigrams that a match of a long template has at least.
DICE, LONG = 0.85, 400
#: Bigrams of the largest template that is compared with runs of whole lines; larger ones have windows of words only.
RUNS = 60

# Notices and texts of public licences.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-licensed": "Licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "all-rights-reserved": "All rights reserved.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}

SHORT = {
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")


def whole_texts() -> dict[str, str]:
    """The licences of the folder license_texts by file name; read at the driver."""
    found = (resources.files(__package__) / "license_texts").iterdir()
    return {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(found, key=lambda f: f.name) if f.name.endswith(".txt")}


def all_templates() -> dict[str, str]:
    return TEMPLATES | SHORT | whole_texts()


def bigrams(text: str) -> Counter:
    ws = WORD.findall(text.lower())
    return Counter(zip(ws, ws[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Templates:
    def __init__(self, texts: dict[str, str], least: float):
        self.least = least
        self.own = [(name, b, b.total()) for name, b in ((n, bigrams(t)) for n, t in texts.items()) if b]
        self.most = [n * (2 - least) / least for *_, n in self.own]
        self.fewest = [n * least / (2 - least) for *_, n in self.own]
        # By the words that a text needs: what short templates have, and what all have.
        self.tiers = [(need, *self._having([i for i, f in enumerate(self.fewest) if f <= limit])) for need, limit in ((0, LONG), (LONG, float("inf")))]

    def _having(self, members: list[int]) -> tuple[dict[tuple[str, str], list[int]], set[str]]:
        having: dict[tuple[str, str], list[int]] = {}
        for i in members:
            for g in self.own[i][1]:
                having.setdefault(g, []).append(i)
        # A line without any of these words shares no bigram.
        return having, {w for g in having for w in g}

    def matches(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coefficient, first line, line after the last) of the best run of each template around each anchor."""
        lines = text.split("\n")
        _, having, known = next(t for t in reversed(self.tiers) if len(text) >= 2 * t[0])
        found: dict[int, Counter | None] = {}

        def of(i: int) -> Counter:
            if i not in found:
                found[i] = bigrams(lines[i])
            return found[i]

        anchors: dict[int, list[int]] = {}
        starts, total, last = [], 0, ""
        shared: dict[int, list[tuple[int, tuple[str, str]]]] = {}
        for i, line in enumerate(lines):
            ws = WORD.findall(line.lower())
            starts.append(total)
            if not known.isdisjoint(ws):
                for p, g in enumerate(zip([last, *ws], ws, strict=False), total - 1):
                    for t in having.get(g, ()):
                        shared.setdefault(t, []).append((p, g))
            total, last = total + len(ws), ws[-1] if ws else last
            if len(ws) > 1 and not known.isdisjoint(ws):
                found[i] = own = Counter(zip(ws, ws[1:], strict=False))
                for t in {t for g in own for t in having.get(g, ())}:
                    anchors.setdefault(t, []).append(i)
        out = []
        # A match has at least as many bigrams in common with the template as the least admissible size.
        shared = {t: at for t, at in shared.items() if len(at) >= ceil(self.fewest[t] - 1e-9)}
        for t, at in sorted(anchors.items()):
            if t not in shared or self.own[t][2] > RUNS:
                continue
            name, want, _ = self.own[t]
            hits = []
            anchored = set(at)
            for first in at:
                # Runs start at an anchor and end at one: other ends only add foreign bigrams.
                run: Counter = Counter()
                for end in range(first, len(lines)):
                    if end > first and lines[end - 1] and (joint := self.joint(lines[end - 1], lines[end])):
                        run[joint] += 1
                    run.update(of(end))
                    size = run.total()
                    if size > self.most[t]:
                        break
                    if end in anchored and size >= self.fewest[t] and (d := dice(run, want)) >= self.least:
                        hits.append((-d, first, end + 1))
            taken: set[int] = set()
            for d, first, end in sorted(hits):
                if taken.isdisjoint(range(first, end)):
                    taken.update(range(first, end))
                    out.append((name, -d, first, end))
        starts.append(total)
        spans = [(name, d, starts[first], starts[end]) for name, d, first, end in out]
        for d, first, end, t in sorted(h for t, at in shared.items() for h in self.windows(t, at)):
            name = self.own[t][0]
            over = [m for m in spans if m[2] < end and first < m[3]]
            if not any(m[0] == name or (m[1] > -d and m[3] - m[2] >= end - first) for m in over):
                spans.append((name, -d, first, end))
                out.append((name, -d, bisect_right(starts, first) - 1, bisect_right(starts, end - 1)))
        return out

    def windows(self, t: int, at: list[tuple[int, tuple[str, str]]]) -> list[tuple[float, int, int, int]]:
        """(-coefficient, first word, word after the last, t) of the best window from each shared bigram to another."""
        _, want, n = self.own[t]
        fewest = ceil(self.fewest[t] - 1e-9)
        if len(at) < fewest:
            return []
        places = np.array([p for p, _ in at])
        number: dict[tuple[str, str], int] = {}
        gram = np.array([number.setdefault(g, len(number)) for _, g in at])
        most = np.array([want[g] for g in number])[gram]
        # Which occurrence of its bigram each is, over the whole text.
        order = np.argsort(gram, kind="stable")
        first_of = np.r_[0, np.flatnonzero(np.diff(gram[order])) + 1]
        nth = np.empty(len(gram), np.int64)
        nth[order] = np.arange(len(gram)) - np.repeat(first_of, np.diff(np.r_[first_of, len(gram)]))
        before, hits = np.zeros(len(number), np.int64), []
        # So many shared bigrams are needed within the largest admissible size.
        some = places[fewest - 1 :] - places[: len(at) - fewest + 1] + 1 <= self.most[t]
        last = np.searchsorted(places, places + self.most[t])
        for i in range(len(at)):
            if i < len(some) and some[i]:
                own = slice(i, last[i])
                common = np.cumsum(nth[own] - before[gram[own]] < most[own])
                d = 2 * common / (places[own] - places[i] + 1 + n)
                j = int(d.argmax())
                if d[j] >= self.least:
                    hits.append((-float(d[j]), int(places[i]), int(places[i + j]) + 2, t))
            before[gram[i]] += 1
        return hits

    @staticmethod
    def joint(a: str, b: str) -> tuple[str, str] | None:
        """The bigram across a line break."""
        left, right = WORD.findall(a.lower()), WORD.search(b.lower())
        return (left[-1], right[0]) if left and right else None


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = DICE) -> DataFrame:
    """One row per match: doc_id, license, dice, first_line, end_line (exclusive; lines count from 0)."""
    texts = templates or all_templates()
    made: list[Templates] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Templates(texts, least))
        rows = [(i, m) for i, t in enumerate(batch.column("text").to_pylist()) if t for m in made[0].matches(t)]
        ids = batch.column("doc_id").take(pa.array([i for i, _ in rows], pa.int64()))
        name, d, first, end = zip(*(m for _, m in rows), strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([ids, pa.array(name, pa.string()), pa.array(d, pa.float64()), pa.array(first, pa.int32()), pa.array(end, pa.int32())], names=["doc_id", "license", "dice", "first_line", "end_line"])

    return map_slices(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, "doc_id long, license string, dice double, first_line int, end_line int")
