"""Licence scans by sentence rules.

Known sentences are looked for in a text's sequence of lower-case words and numbers, by their rarest word: line ends, comment
prefixes and punctuation don't count, so a hard-wrapped licence or one in a comment reads as the plain one. Each that is found
becomes its identifier; one that stands within a longer one doesn't count. A sentence may leave a place for a holder's name, of HOLDER words at
most. A tag `SPDX-License-Identifier:` is parsed as an expression of licences with AND, OR, WITH and brackets, each of which is an identifier; an
exception is not named, and forms such as `GPL-2.0`, `GPL-2.0+`, `GPL-2.0-only` and `GPL-2.0-or-later` are one licence. A rule is an ordered list of identifiers; it
matches where its identifiers follow each other in the text with at most GAP unknown sentences between two; sentences end at
full stops and blank lines. At each place the longest rule wins, and its sentences are used up.

A span goes from the first word to the last; where these begin and end a line or sentence, its punctuation belongs to it.

Defined results: null and empty texts have no matches; repeated rows give equal results; two rules of one length that
match at one place are both given, by name. A column of the output's name is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

GAP, HOLDER = 2, 20

# Sentences of public licences and notices, and the rules made of them, in order.
SENTENCES = {
    "mit-notice": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice-kept": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "no-liability": ["IN NO EVENT SHALL {} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "apache-notice": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "apache-compliance": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2-notice": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "lgpl21-free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl3-free": [f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version." for thing in ("library", "program")],
    "agpl3-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "isc-notice": ["Licensed under the ISC License."],
    "isc-grant": [f"Permission to use, copy, modify, {and_or} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." for and_or in ("and/or", "and")],
    "epl1-notice": ["made available under the terms of the Eclipse Public License v1.0"],
    "epl2-notice": ["made available under the terms of the Eclipse Public License 2.0", "made available under the terms of the Eclipse Public License v2.0", "made available under the terms of the Eclipse Public License v. 2.0"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-see": ["See the GNU General Public License for more details."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-advert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "bsd-names": ["Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "endorse or promote products derived from this software without specific prior written permission.", "endorse or promote products derived from this software"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "mpl-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "reserved": ["All rights reserved."],
}
RULES = {
    "MIT": [["mit-notice"], ["mit-grant", "mit-notice-kept", "as-is", "no-liability"], ["mit-grant", "mit-notice-kept"], ["mit-grant"]],
    "Apache-2.0": [["apache-notice"], ["apache-notice", "apache-compliance", "apache-copy", "apache-as-is", "apache-see"], ["apache-compliance", "apache-copy"]],
    "GPL-3.0": [["gpl3-notice"], ["gpl-free", "gpl-hope", "gpl-see"], ["gpl-free"]],
    "GPL-2.0": [["gpl2-notice"], ["gpl2-free", "gpl-hope", "gpl-see"], ["gpl2-free"]],
    "LGPL-2.1": [["lgpl21-free"]],
    "LGPL-3.0": [["lgpl3-free"]],
    "AGPL-3.0": [["agpl3-free"]],
    "ISC": [["isc-notice"], ["isc-grant"]],
    "EPL-1.0": [["epl1-notice"]],
    "EPL-2.0": [["epl2-notice"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary"]],
    "BSD-4-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert"], ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-names"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]],
    "CC-BY-NC-4.0": [["cc-by-nc"]],
    "CC-BY-SA-4.0": [["cc-by-sa"]],
    "CC-BY-4.0": [["cc-by"]],
    "CC0-1.0": [["cc0"]],
    "MPL-2.0": [["mpl-notice"]],
    "Unlicense": [["unlicense"]],
    "LicenseRef-reserved": [["reserved"]],
}

# Where spans may end with their punctuation, where sentences end, and words that only mark a comment at a line's start.
_CUT = re.compile(r"(?<=[.:;!?])\s+|\n+")
_STOP = re.compile(r"(?<=[.:;!?])\s+|\n(?:[^\w\n]*+\n)+")
_MARKS = {"dnl", "rem"}
_TAG = re.compile(r"SPDX-License-Identifier:[ \t]*", re.I)
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9.+:-]+)")
# Licences that a tag may name besides those with rules.
TAGGED = (
    "0BSD Artistic-2.0 BSL-1.0 CC-BY-3.0 CC-BY-ND-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-SA-3.0 CDDL-1.0 CDDL-1.1 GFDL-1.3 GPL-1.0 LGPL-2.0 MIT-0 MPL-1.1 MS-PL MS-RL "
    "NCSA OFL-1.1 OpenSSL PostgreSQL PSF-2.0 Python-2.0 Ruby Unicode-DFS-2016 UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def normalised(sentence: str) -> str:
    return " ".join(_WORD.findall(sentence.lower()))


class Rules:
    """sentences: texts by identifier; rules: lists of identifiers by licence."""

    def __init__(self, sentences: dict[str, list[str]], rules: dict[str, list[list[str]]]):
        #: The words before a holder's name, or all, and those after it, to the identifier.
        self.known = {tuple(tuple(normalised(p).split()) for p in s.split("{}")): k for k, several in sentences.items() for s in several}
        self.tags = {f"{n}{end}".lower(): n for n in (*rules, *TAGGED) for end in ("", "+", "-only", "-or-later")}
        often: dict[str, int] = defaultdict(int)
        for words, *_ in self.known:
            for word in set(words):
                often[word] += 1
        self.anchors: dict[str, list[tuple[int, tuple[tuple[str, ...], ...]]]] = defaultdict(list)
        for known in sorted(self.known):
            rarest = min(known[0], key=lambda w: (often[w], -len(w), w))
            self.anchors[rarest].append((known[0].index(rarest), known))
        self.anywhere = re.compile("|".join(map(re.escape, sorted({*self.anchors, "spdx"}, key=lambda w: (-len(w), w)))))
        by_first: dict[str, list[tuple[list[str], str]]] = defaultdict(list)
        for name, several in rules.items():
            for rule in several:
                by_first[rule[0]].append((rule, name))
        self.by_first = {k: sorted(v, key=lambda x: (-len(x[0]), x[1])) for k, v in by_first.items()}

    def identifiers(self, text: str) -> list[tuple[int, int, int, int, str]]:
        """Known sentences in order: numbers of the sentences of the text where each begins and ends, start, end, identifier.
        A text that has no known sentence's rarest word has none of them, and is not read."""
        if not self.anywhere.search(text.lower()):
            return []
        places, words = [], []
        for m in _WORD.finditer(text):
            word = m[0].lower()
            if word in _MARKS:
                line = text.rfind("\n", 0, m.start()) + 1
                if not text[line : m.start()].strip():
                    continue
            places.append((m.start(), m.end()))
            words.append(word)
        found = []
        for i, word in enumerate(words):
            for offset, known in self.anchors.get(word, ()):
                if (a := i - offset) >= 0 and (b := self._end(words, a, known)) is not None:
                    found.append((a, b, self.known[known]))
        tags = list(self._tagged(text))
        if not found and not tags:
            return []
        begins = [a for a, _ in places]
        first, last, begin = {}, {}, 0
        for piece in [*_CUT.finditer(text), None]:
            end = piece.start() if piece else len(text)
            a, b = bisect_left(begins, begin), bisect_left(begins, end) - 1
            if a <= b:
                first[a], last[b] = begin, end
            begin = piece.end() if piece else end
        stops = sorted({bisect_left(begins, m.end()) for m in _STOP.finditer(text)} - {0})
        out, reach = [], -1
        for a, b, name in sorted(set(found), key=lambda x: (x[0], -x[1], x[2])):
            if b <= reach:  # within the one before
                continue
            reach = b
            whole = a in first and b in last
            start, end = (first[a], last[b]) if whole else (places[a][0], places[b][1])
            out.append((bisect_right(stops, a), bisect_right(stops, b), start, end, name))
        for start, end, name in tags:
            a, b = (bisect_right(stops, bisect_right(begins, x) - 1) for x in (start, end - 1))
            out.append((a, b, start, end, f"spdx:{name}"))
        return sorted(out, key=lambda x: x[2]) if tags else out

    @staticmethod
    def _end(words: list[str], a: int, known: tuple[tuple[str, ...], ...]) -> int | None:
        """The last word of a known sentence that begins at word a; None if it doesn't."""
        head, *tails = known
        b = a + len(head)
        if words[b - 1 : b] != [head[-1]] or tuple(words[a:b]) != head:
            return None
        for tail in tails:
            for c in range(b + 1, min(b + HOLDER, len(words) - len(tail)) + 1):
                if words[c] == tail[0] and tuple(words[c : c + len(tail)]) == tail:
                    b = c + len(tail)
                    break
            else:
                return None
        return b - 1

    def _tagged(self, text: str) -> Iterator[tuple[int, int, str]]:
        """The licences of SPDX tags: start and end of the tag and its expression, name."""
        for tag in _TAG.finditer(text):
            at, depth, names, wanted = tag.end(), 0, {}, "name"
            while token := _TOKEN.match(text, at):
                word = token[1].rstrip(".") if wanted != "name" else token[1]
                if wanted == "name" and word == "(":
                    depth += 1
                elif wanted == "name" and (name := self.tags.get(word.lower()) or (word if word.lower().startswith("licenseref-") else None)):
                    names[name], wanted = token.end(1), "more"
                elif wanted == "more" and word == ")" and depth:
                    depth -= 1
                    names = dict.fromkeys(names, token.end(1))
                elif wanted == "more" and word.upper() in ("AND", "OR"):
                    wanted = "name"
                elif wanted == "more" and word.upper() == "WITH":
                    wanted = "exception"
                elif wanted == "exception" and word not in "()":
                    names, wanted = dict.fromkeys(names, token.end(1)), "more"
                else:
                    break
                at = token.end()
            end = max(names.values(), default=0)
            yield from ((tag.start(), end, n) for n in sorted(names))

    def matches(self, text: str) -> list[tuple[int, int, str]]:
        """Spans of licences: start, end, name."""
        found, out, i = self.identifiers(text), [], 0
        while i < len(found):
            best, names, last = 0, [], i
            first = found[i][4]
            for rule, name in [([first], first[5:])] if first.startswith("spdx:") else self.by_first.get(first, ()):
                if len(rule) < best:
                    break
                j = i
                for wanted in rule[1:]:
                    if j + 1 < len(found) and found[j + 1][4] == wanted and found[j + 1][0] - found[j][1] <= GAP + 1:
                        j += 1
                    else:
                        break
                else:
                    best, last = len(rule), j
                    names.append(name)
            out += ((found[i][2], found[last][3], name) for name in names)
            i = last + 1
        return out


@lru_cache(maxsize=1)
def standard() -> Rules:
    return Rules(SENTENCES, RULES)


def licences(text: Column, rules: Rules | None = None) -> Column:
    """array<struct<start, end, licence>> of each text."""

    @F.arrow_udf("array<struct<start:int,end:int,licence:string>>")
    @tk.lean
    def scanned(column: pa.Array) -> pa.Array:
        own = rules or standard()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("licence", pa.string())]))
        return pa.array([[{"start": a, "end": b, "licence": n} for a, b, n in own.matches(t or "")] for t in column.to_pylist()], kind)

    return scanned(text)


def scan(docs: DataFrame, text: str = "text", out: str = "licences", rules: Rules | None = None) -> DataFrame:
    """docs with the licences of each text in column `out`."""
    return docs.withColumn(out, licences(F.col(text), rules))
