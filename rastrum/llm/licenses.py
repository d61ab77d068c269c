"""Licence scan: a generalised suffix automaton of licence templates gives matching statistics of streamed documents.

The automaton holds every token substring of every template in a number of states linear in the templates' length. A document
streams through it token by token; the matching statistic at a token is the length of the longest template substring that
ends there, and the state reached tells all places where templates hold it. Long matches of one template that follow each other in
document and template are chained, and a chain that covers enough of the template is reported as its span. A chain is closed as soon as
no match can follow it, so the time is linear in the text however often it repeats a licence.

Only where two neighbouring words stand side by side in some template can a statistic exceed one, so runs of such places are
found by table lookup first and only they are streamed; this leaves every statistic of two or more as it is.

Defined cases: null texts count as empty; words are runs of ASCII letters, digits and non-ASCII characters of the text with
A-Z lower-cased; repeated rows are scanned one by one; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_batch

#: Base phrases and their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
#: Well-known licence texts and notices, by label.
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_AUTHOR_TAIL = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        _AS_IS + "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
    ),
    "apache": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed under the Apache License, Version 2.0.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        "Licensed under the GNU Affero General Public License, version 3.",
    ),
    "gfdl": ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts. A copy of the license is included in the section entitled GNU Free Documentation License.",),
    "bsd-2": (_BSD_HEAD + _BSD_TAIL,),
    "bsd-3": (_BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL,),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AUTHOR_TAIL,),
    "0bsd": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AUTHOR_TAIL,),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "bsl": (
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
        "Distributed under the Boost Software License, Version 1.0.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
    "wtfpl": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",),
    "postgresql": ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",),
    "cddl": ("The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.",),
    "eupl": ("Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL (the Licence); You may not use this work except in compliance with the Licence.",),
    "ofl": ("This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at",),
    "artistic": ("This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc-by-nc-sa": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "cc-by-nc-nd": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
}
#: Shortest match that counts, in words, the largest gap between two matches of a chain, and the share of a template that a chain must cover.
MIN_MATCH, MAX_GAP, COVER = 3, 8, 0.6
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    """Words as UTF-8 bytes; bytes.lower() touches A-Z only, and each byte of a non-ASCII character is 0x80 or more."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Automaton:
    """Generalised suffix automaton over token numbers, with the places (template, last token) of each state's substrings."""

    def __init__(self, texts: Iterable[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, list[tuple[int, int]]] = {}
        for t, tokens in enumerate(texts):
            last = 0
            for i, x in enumerate(tokens):
                last = self._extend(last, x)
                ends.setdefault(last, []).append((t, i))
        self._ends, self._below, self._places = ends, {}, {}
        for q, p in enumerate(self.link):
            self._below.setdefault(p, []).append(q)

    def places(self, state: int) -> list[tuple[int, int]]:
        """Where templates hold the state's substrings: its own places and those of all states that link to it."""
        if state not in self._places:
            found, todo = [], [state]
            while todo:
                q = todo.pop()
                found += self._ends.get(q, ())
                todo += self._below.get(q, ())
            self._places[state] = sorted(found)
        return self._places[state]

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, x: int) -> int:
        clone = self._new(self.length[p] + 1)
        self.next[clone] = dict(self.next[q])
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x], p = clone, self.link[p]
        return clone

    def _extend(self, last: int, x: int) -> int:
        if (q := self.next[last].get(x)) is not None:  # an earlier template has it
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, x)
        cur, p = self._new(self.length[last] + 1), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x], p = cur, self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, x)
        return cur

    def stream(self, tokens: Iterable[int]) -> list[tuple[int, int]]:
        """(matching statistic, state) at each token; -1 is a token that no template has."""
        out, state, n = [], 0, 0
        for x in tokens:
            while state and x not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if x in self.next[state]:
                state, n = self.next[state][x], n + 1
            else:
                n = 0
            out.append((n, state))
        return out


class Index:
    """Templates as token numbers, their automaton, and a table of the word pairs that they hold."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        self.labels = [k for k, texts in templates.items() for _ in texts]
        split = [words_of(t) for texts in templates.values() for t in texts]
        self.ids: dict[bytes, int] = {}
        for w in [w for t in split for w in t] + [w.encode() for p in PHRASES for w in p]:
            self.ids.setdefault(w, len(self.ids))
        self.texts = [[self.ids[w] for w in t] for t in split]
        self.automaton = Automaton(self.texts)
        n = len(self.ids) + 1  # the last number stands for unknown words
        self.pairs = np.zeros((n, n), bool)
        for t in [*self.texts, *([self.ids[w.encode()] for w in p] for p in PHRASES)]:
            self.pairs[t[:-1], t[1:]] = True
        self.phrases = [(tuple(self.ids[w.encode()] for w in p), label) for p, label in PHRASES.items()]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """(base places with labels, chained template spans as start, end, label, covered share)."""
        unknown = len(self.ids)
        get = self.ids.get
        ids = np.fromiter((get(w, unknown) for w in words), np.int32, len(words))
        if len(ids) < 2:
            return [], []
        hit = np.flatnonzero(self.pairs[ids[:-1], ids[1:]])
        if not len(hit):
            return [], []
        breaks = np.flatnonzero(np.diff(hit) > 1)
        base, matches = [], []
        for s, e in zip(hit[np.r_[0, breaks + 1]].tolist(), (hit[np.r_[breaks, len(hit) - 1]] + 2).tolist(), strict=True):
            run = ids[s:e].tolist()
            for phrase, label in self.phrases:
                k = len(phrase)
                base += [(s + i, label) for i in range(len(run) - k + 1) if tuple(run[i : i + k]) == phrase]
            if e - s < MIN_MATCH:
                continue
            stats = self.automaton.stream(run)
            for i, (n, state) in enumerate(stats):
                if n >= MIN_MATCH and (i + 1 == len(stats) or stats[i + 1][0] <= n):  # the match can't be made longer to the right
                    matches += [(t, end - n + 1, s + i - n + 1, n) for t, end in self.automaton.places(state)]
        return sorted(base), self._chains(matches)

    def _chains(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, str, float]]:
        """Chains of (template, template start, document start, length): a match goes on with the oldest open chain of its template that ends
        at most MAX_GAP words before it in both; chains that cover COVER of their template are kept."""
        out = []
        by: dict[int, list[tuple[int, int, int]]] = {}
        for t, p, d, n in matches:
            by.setdefault(t, []).append((d, p, n))
        for t, found in by.items():
            done, open_ = [], []  # chains: document start, document end, template end, covered words
            for d, p, n in sorted(found):
                if any(d - c[1] > MAX_GAP for c in open_):
                    done += [c for c in open_ if d - c[1] > MAX_GAP]
                    open_ = [c for c in open_ if d - c[1] <= MAX_GAP]
                for c in open_:
                    if 0 <= d - c[1] and 0 <= p - c[2] <= MAX_GAP:
                        c[1], c[2], c[3] = d + n, p + n, c[3] + n
                        break
                else:
                    open_.append([d, d + n, p + n, n])
            out += [(c[0], c[1], self.labels[t], c[3] / len(self.texts[t])) for c in done + open_ if c[3] >= COVER * len(self.texts[t])]
        return sorted(set(out))


@cache
def _index() -> Index:
    return Index()


def scan_text(text: str) -> dict:
    """Counts, places and labels of one text."""
    words = words_of(text)
    base, spans = _index().scan(words)
    labels = {x for _, x in base}
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min((p for p, _ in base), default=None),
        "last_word": max((p for p, _ in base), default=None),
        "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(labels | {x for _, _, x, _ in spans})),
        "score": min(1.0, max([1.0 if base else 0.0, *(s for *_, s in spans)])),
        "spans": ",".join(f"{x}:{s}:{e}" for s, e, x, _ in spans),
    }


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label:first word:end word)."""
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string())]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan_text(t or "") for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in fields)], names=["doc_id", *(k for k, _ in fields)])

    return per_batch(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
