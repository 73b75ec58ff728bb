"""License scans by a generalised suffix automaton.

The automaton holds every substring of the token sequences of the license templates. A document's tokens are streamed through
it: at each position the state gives the longest suffix of what was read that occurs in a template (the matching statistics). Matches
that end (the next token doesn't lengthen them) and have ``LEAST`` tokens or more are kept with the template positions at which they
occur, and are chained: matches in the order of both document and template, at most ``GAP`` tokens apart on either side, make
one span that covers a part of a template. A span is reported if it covers ``COVER`` of its template, or all of one of ``SHORT`` tokens or fewer, which
differs from other licenses by a word; for a document, overlapping spans are cut to the best template.

Tokens are runs of ASCII letters, digits and dots inside numbers, in lower case; case, punctuation and white space don't count.

Defined results: null and empty texts and texts without a token have no spans. A partial span falls to a complete one that overlaps it and isn't inside it. Of other spans that overlap, the one with more covered tokens stays, then the one that covers
more of its template, then the first by name. Repeated rows repeat their spans; an empty table gives none. Texts of any length are streamed
whole. Only doc_id and text are read; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from auditloom.llm.common import frugal

#: Shortest match that is kept, tokens between matches of a chain, and the part of a template that a span must cover.
LEAST = 3
GAP = 8
COVER = 0.6
#: Templates of so many tokens or fewer must be covered whole.
SHORT = 12

TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": "Released under the MIT License",
    "MIT-licensed": "Licensed under the MIT License",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
        THE SOFTWARE.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-2.0": "licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
        You can obtain one at https://mozilla.org/MPL/2.0/""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
        OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use
        of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
        subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
        this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked
        as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this
        license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
        third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the
        above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
        Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.""",
    "CC-BY-4.0": "licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "licensed under CC BY-SA 4.0",
    "CC-BY-4.0-text": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}

_TOKEN = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end) with character offsets."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is two characters: then only ASCII is lowered, and every character keeps its place
        low = text.translate(_LOWER)
    return [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(low)]


_LOWER = {c: c + 32 for c in range(65, 91)}


class SuffixAutomaton:
    """Of several sequences. States by number: transitions, suffix link, longest length, and (sequence, end) of occurrences."""

    def __init__(self, sequences: list[list[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.first: list[list[tuple[int, int]]] = [[]]
        for k, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c)
                self.first[last].append((k, i + 1))
        # An occurrence of a state is one of all states whose link chain leads to it.
        self.ends: list[list[tuple[int, int]]] = [list(x) for x in self.first]
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                self.ends[self.link[v]] = sorted(set(self.ends[self.link[v]]) | set(self.ends[v]))

    def _state(self, length: int, link: int, nexts: dict[str, int]) -> int:
        self.next.append(nexts), self.link.append(link), self.length.append(length), self.first.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: str) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: str) -> int:
        q = self.next[last].get(c)
        if q is not None:  # the sequence before has had this much
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def matches(self, words: list[str], least: int) -> list[tuple[int, int, int]]:
        """(start, end, state) of the matches of least tokens or more that the next token doesn't lengthen."""
        out: list[tuple[int, int, int]] = []
        nexts, link, length = self.next, self.link, self.length
        root, v, n = nexts[0], 0, 0
        for i, w in enumerate(words):
            if not v:
                if w in root:
                    v, n = root[w], 1
                continue
            if w in nexts[v]:
                v, n = nexts[v][w], n + 1
                continue
            if n >= least:
                out.append((i - n, i, v))
            while v and w not in nexts[v]:
                v = link[v]
            n = length[v]
            if w in nexts[v]:
                v, n = nexts[v][w], n + 1
        if n >= least:
            out.append((len(words) - n, len(words), v))
        return out


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, least: int = LEAST, gap: int = GAP, cover: float = COVER):
        self.names = sorted(templates)
        self.seqs = [[t for t, _, _ in tokens(templates[k])] for k in self.names]
        self.automaton = SuffixAutomaton(self.seqs)
        self.least, self.gap, self.cover = least, gap, cover

    def spans(self, text: str | None) -> list[tuple[int, int, str, int, float]]:
        """(start, end, template, tokens covered, share of the template) in characters of the text."""
        if not text:
            return []
        toks = tokens(text)
        found = self.automaton.matches([t for t, _, _ in toks], self.least)
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        for s, e, v in found:
            for k, end in self.automaton.ends[v]:
                by.setdefault(k, []).append((s, e, end - (e - s), end))
        out = []
        for k, ms in by.items():
            for s, e, covered in self._chains(sorted(ms)):
                share = covered / len(self.seqs[k])
                if share >= (1 if len(self.seqs[k]) <= SHORT else self.cover):
                    out.append((covered, share, self.names[k], s, e))
        complete = [(s, e) for _, share, _, s, e in out if share >= 1]
        out = [x for x in out if x[1] >= 1 or not any(s < x[4] and x[3] < e and not x[3] <= s < e <= x[4] for s, e in complete)]
        out.sort(key=lambda x: (-x[0], -x[1], x[2], x[3]))
        kept: list[tuple] = []
        for covered, share, name, s, e in out:
            k = bisect_left(kept, (s,))  # those kept are apart, so only the neighbours can overlap
            if (k == 0 or kept[k - 1][1] <= s) and (k == len(kept) or e <= kept[k][0]):
                kept.insert(k, (s, e, name, covered, share))
        return [(toks[s][1], toks[e - 1][2], name, covered, round(share, 6)) for s, e, name, covered, share in kept]

    def _chains(self, ms: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
        """(start, end, covered) of the best chains of one template's matches; each match is in one of them."""
        best = [e - s for s, e, _, _ in ms]
        back = [-1] * len(ms)
        lo = 0
        for i, (s, e, a, b) in enumerate(ms):
            while lo < i and ms[lo][1] + self.gap < s:
                lo += 1
            for j in range(lo, i):
                s2, e2, _, b2 = ms[j]
                if s2 < s and -self.gap <= e2 - s <= 0 or (e2 > s > s2 and e2 < e):
                    skip = max(0, e2 - s, b2 - a)  # tokens that both would cover
                    if a + skip >= b2 and a - b2 <= self.gap and e - s - skip > 0 and best[j] + e - s - skip > best[i]:
                        best[i], back[i] = best[j] + e - s - skip, j
        used, out = [False] * len(ms), []
        for i in sorted(range(len(ms)), key=lambda i: (-best[i], i)):
            if used[i]:
                continue
            j, first = i, i
            whole = True
            while j >= 0:
                if used[j]:
                    whole = False
                    break
                first, j = j, back[j]
            if not whole:
                continue
            j = i
            while j >= 0:
                used[j] = True
                j = back[j]
            out.append((ms[first][0], ms[i][1], best[i]))
        return out


_scanner: list[Scanner] = []
_OUT = "doc_id bigint, start int, end int, license string, tokens int, share double"


def scan(docs: DataFrame) -> DataFrame:
    """One row for each span of license text: doc_id, its place in characters, the template, tokens of it that are covered, and their share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner())
        spans, kinds = _scanner[0].spans, [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64()]
        for batch in batches:
            rows = [(i, *x) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in spans(t)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _OUT.split(", ")])

    return docs.selectExpr("try_cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(frugal(run), _OUT)
