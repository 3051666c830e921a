"""License scan by patience alignment against templates.

A text and a template are word sequences. Words that occur once in each are anchors;
the longest increasing subsequence of their places is kept, and the gaps between kept
anchors are aligned in the same way. Coverage is the share of template words aligned.
Long texts are aligned in overlapping windows around the template's rare words, so that
words which recur elsewhere in a document stay unique where they matter.

Null and empty texts match nothing. All matches of a document are reported; where they
overlap, the one with the most aligned words; ties go to the better covered, then the shorter
span, then the name that sorts first. A match holds the words that tell licenses apart
(Lesser, Affero, NC, SA, ND; in notices names and versions too) as its template does, and a
notice holds few words between its own. A window reaches one and a half template lengths, so
a text with longer insertions is several pieces, each judged alone. Repeated rows each give a
row, an empty table none. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Public licence notices.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-notice": "Released under the MIT License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-1.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "EPL-1.0": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, version 2.0.",
    "BSD-notice": "Released under the BSD License.",
    "BSD-2-Clause-notice": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License.",
    "ISC-notice": "Released under the ISC License.",
}
_CC = {"NonCommercial": "NC", "ShareAlike": "SA", "NoDerivatives": "ND", "NonCommercial-ShareAlike": "NC-SA", "NonCommercial-NoDerivatives": "NC-ND"}
for _version, _law in (("3.0", "Unported"), ("4.0", "International")):
    TEMPLATES.setdefault(f"CC-BY-{_version}-short", f"Licensed under CC BY {_version}.")
    TEMPLATES.setdefault(f"CC-BY-{_version}-notice", f"This work is licensed under a Creative Commons Attribution {_version} {_law} License.")
    for _long, _short in _CC.items():
        TEMPLATES[f"CC-BY-{_short}-{_version}-notice"] = f"Licensed under CC BY-{_short} {_version}."
        TEMPLATES[f"CC-BY-{_short}-{_version}"] = f"This work is licensed under a Creative Commons Attribution-{_long} {_version} {_law} License."
for _file in sorted(Path(__file__).with_name("license_texts").glob("*.txt")):  # whole texts
    TEMPLATES[f"{_file.stem}-text"] = _file.read_text(encoding="utf-8")
TEMPLATES["MIT-text"] = TEMPLATES["MIT"] + " THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
# Words that tell one license from its relatives: a match has just those of the template.
TELLING = frozenset("affero derivatives lesser nc nd noderivatives noderivs noncommercial sa sharealike".split())
NAMES = frozenset("agpl apache bsd cc commons creative eclipse epl gnu gpl isc lgpl mit mozilla mpl".split())
NOTICE = 150  # words; in a template up to this length the numbers tell versions apart

_WORD = re.compile(r"[a-z0-9]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        if p == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[p], piles[p] = v, i
        back[i] = piles[p - 1] if p else -1
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned places (text, template), increasing in both."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        wanted: dict[str, int] = {}
        for j in range(b0, b1):
            wanted[template[j]] = -1 if template[j] in wanted else j
        seen: dict[str, int] = {}
        for i in range(a0, a1):
            if text[i] in wanted:
                seen[text[i]] = -1 if text[i] in seen else i
        anchors = sorted((i, wanted[w]) for w, i in seen.items() if i >= 0 and wanted[w] >= 0)
        kept = [anchors[k] for k in _increasing([j for _, j in anchors])]
        out += kept
        if kept:
            for (i, j), (x, y) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)]):
                todo.append((i + 1, x, j + 1, y))
    return sorted(out)


class Scanner:
    """Templates with, for each, rare words of which any sufficient match holds one."""

    def __init__(self, templates: dict[str, str], coverage: float) -> None:
        self.coverage = coverage
        self.templates = {k: words_of(v) for k, v in templates.items()}
        self.counts = {k: Counter(v) for k, v in self.templates.items()}
        common: dict[str, int] = {}
        for words in self.templates.values():
            for w in set(words):
                common[w] = common.get(w, 0) + 1
        self.rare = {}
        for name, words in self.templates.items():
            # More words than may be missing: a match must hold at least one of them.
            chosen, missing = [], int((1 - coverage) * len(words) + 1e-9)
            for w in sorted(set(words), key=lambda w: (common[w], -len(w), w)):
                chosen.append(w)
                missing -= words.count(w)
                if missing < 0:
                    break
            self.rare[name] = frozenset(chosen)

    def _tells(self, name: str, words: list[str], pairs: list[tuple[int, int]]) -> bool:
        """Are the words that tell licenses apart the template's, and is a notice in one piece?"""
        template, aligned = self.templates[name], {j for _, j in pairs}
        notice = len(template) <= NOTICE
        tell = TELLING | NAMES if notice else TELLING
        if any(j not in aligned and (w in tell or (notice and w.isdigit())) for j, w in enumerate(template)):
            return False
        taken = {i for i, _ in pairs}
        between = [words[i] for i in range(pairs[0][0], pairs[-1][0]) if i not in taken]
        most = max(1, int((1 - self.coverage) * len(template) + 1e-9)) + (len(template) - len(pairs))
        return tell.isdisjoint(between) and (len(template) > 12 or len(between) <= most)

    def find(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, end word) of every match, by place."""
        low = (text or "").lower()
        # A long template is sought by its words' counts, in texts that are long enough.
        names = [n for n, rare in self.rare.items() if (len(low) > 1.9 * self.coverage * len(self.templates[n]) if len(self.templates[n]) > NOTICE else any(w in low for w in rare))]
        if not names:
            return []
        words = _WORD.findall(low)
        found = []
        held = Counter(words) if any(self.coverage * len(self.templates[n]) <= len(words) for n in names) else Counter()
        for name in names:
            template, rare = self.templates[name], self.rare[name]
            least = self.coverage * len(template) - 1e-6
            if len(words) < least or sum(n for w, n in self.counts[name].items() if w in held) < least or sum(min(n, held[w]) for w, n in self.counts[name].items()) < least:
                continue
            reach, until = len(template) + len(template) // 2, -1
            for i, w in enumerate(words):
                if w not in rare or i < until:
                    continue
                lo, hi = max(0, i - reach), min(len(words), i + reach)
                pairs = align(words[lo:hi], template)
                while len(pairs) > 1 and pairs[-1][0] - pairs[0][0] >= 2 * len(template):  # stray ends
                    pairs = pairs[1:] if pairs[1][0] - pairs[0][0] > pairs[-1][0] - pairs[-2][0] else pairs[:-1]
                share = len(pairs) / len(template)
                if pairs and share >= self.coverage - 1e-9:
                    until = lo + pairs[-1][0] + 1
                    if self._tells(name, words[lo:hi], pairs):
                        found.append((name, share, lo + pairs[0][0], lo + pairs[-1][0] + 1))
                elif len(template) > NOTICE:
                    until = i + len(template) // 4  # the window reaches beyond a match that starts there
        kept: list[tuple[str, float, int, int]] = []
        for m in sorted(found, key=lambda m: (-round(m[1] * len(self.templates[m[0]])), -m[1], m[2] - m[3], m[0])):
            if all(m[3] <= k[2] or m[2] >= k[3] for k in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: m[2])


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """One row per document: doc_id and ``matches``, an array of struct(license, coverage,
    start, stop); places count words ``[a-z0-9]+`` of the lower-cased text."""
    scanner = Scanner(templates or TEMPLATES, coverage)

    @F.pandas_udf("array<struct<license:string,coverage:double,start:int,stop:int>>")
    def matches(bodies):
        return pd.Series([[dict(zip(("license", "coverage", "start", "stop"), m)) for m in scanner.find(b)] for b in bodies])

    return docs.select(F.col(doc_id).alias("doc_id"), matches(F.col(text).cast("string")).alias("matches"))
