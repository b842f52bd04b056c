"""Licence scan: Dice coefficient over word bigrams between normalised text and licence templates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Licence notices and short licence texts, from the licences' own publications.
TEMPLATES = {
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: The whole licence beside its permission notice, which also stands alone.
TEMPLATES["MIT-license"] = TEMPLATES["MIT-text"] + " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_mark = re.compile(r"[^\w.\-]+|[.\-]+(?!\w)|(?<!\w)[.\-]+")


def words_of(text: str) -> list[str]:
    return _mark.sub(" ", text.lower()).split()


def bigrams(text: str) -> set[tuple[str, str]]:
    """Distinct word bigrams of a normalised text: lower case, marks to spaces; a single word pairs with nothing."""
    words = words_of(text)
    return set(zip(words, words[1:])) if len(words) > 1 else {(w, "") for w in words}


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def repetitions(ids: list[int]) -> tuple[list[int], list[int]]:
    """For each place: the next one of its number (or the end), and for how many places at least the numbers go on as
    they did from its last one."""
    n = len(ids)
    earlier, last = [-1] * n, {}
    for i, x in enumerate(ids):
        earlier[i] = last.get(x, -1)
        last[x] = i
    later, repeats, following = [n] * n, [0] * n, {}
    for i in range(n - 1, -1, -1):
        later[i] = following.get(ids[i], n)
        following[ids[i]] = i
        if earlier[i] >= 0:
            goes_on = i + 1 < n and earlier[i + 1] >= 0 and i + 1 - earlier[i + 1] == i - earlier[i]
            repeats[i] = 1 + (repeats[i + 1] if goes_on else 0)
    return later, repeats


class Matcher:
    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.of = sorted((name, bigrams(text)) for name, text in templates.items())
        ratio = least / (2 - least)
        #: Dice >= least needs the smaller set to be at least this share of the larger: templates by size of the text.
        self.bounds = [(len(b) * ratio, len(b) / ratio) for _, b in self.of]
        self.most = max(hi for _, hi in self.bounds)
        self.every = set().union(*(b for _, b in self.of))
        self.fits = {n: [k for k, (lo, hi) in enumerate(self.bounds) if lo <= n <= hi] for n in range(int(self.most) + 1)}

    def best(self, text: str) -> tuple[float, str] | None:
        """Largest coefficient and its template's name (the first by name of equals), if it is at least `least`."""
        # A text of n characters has n / 2 words at most; one far above every template has more distinct bigrams only
        # if its words vary, so only a cheap lower bound may reject before the set is made: none is used but emptiness.
        own = bigrams(text)
        found = None
        for k in self.fits.get(len(own), ()):
            score = dice(own, self.of[k][1])
            if score >= self.least and (found is None or score > found[0]):
                found = score, self.of[k][0]
        return found

    def window(self, text: str) -> tuple[float, str, int] | None:
        """Largest coefficient over all windows of the text's words, its template, and the window's first line.

        A window of the coefficient has at least least / (2 - least) of the template's bigrams; texts with fewer are
        passed over. A best window begins and ends with bigrams of the template, and only one that it had not yet makes
        it better: so each such beginning is drawn out, its distinct bigrams counted, until it has all that the text
        has, or more distinct ones than any match, or the bigram that it began with comes again: from there on the window
        that begins one later has the same bigrams. A beginning after which the text repeats what followed when its bigram
        last stood there is no better than that one, and not drawn out. So each bigram of a text is met at most as often
        as a match has distinct ones, however much a text repeats itself. Of equal windows the first counts.
        """
        words = words_of(text)
        pairs = list(zip(words, words[1:]))
        near = self.every.intersection(pairs)
        wanted = [(name, template, hi, shared) for (name, template), (lo, hi) in zip(self.of, self.bounds, strict=True) if (shared := len(near & template)) >= lo - 1e-9]
        if not wanted:
            return None
        number: dict[tuple[str, str], int] = {}
        ids = [number.setdefault(p, len(number)) for p in pairs]
        later, repeats = repetitions(ids)
        found = None
        for name, template, hi, shared in wanted:
            own = {number[p] for p in near & template}
            in_window = [-1] * len(number)  # by bigram, the beginning that met it last
            drawn: dict[int, tuple[int, bool]] = {}  # by bigram: how far its last beginning went, and whether that was all
            for i, first in enumerate(ids):
                if first not in own:
                    continue
                took, ended = drawn.get(first, (0, False))
                if took and repeats[i] >= took and (ended or later[i] - i <= took):
                    continue
                distinct = both = 0
                ended = False
                for j in range(i, later[i]):
                    p = ids[j]
                    if in_window[p] == i:
                        continue
                    in_window[p] = i
                    distinct += 1
                    if distinct > hi + 1e-9:
                        ended = True
                        break
                    if p in own:
                        both += 1
                        score = 2 * both / (distinct + len(template))
                        if score >= self.least and (found is None or score > found[0]):
                            found = score, name, i
                        if both == shared:
                            ended = True
                            break
                drawn[first] = j - i + 1, ended
        if not found:
            return None
        at, line = found[2], 0
        for line, of in enumerate(text.split("\n")):
            at -= len(words_of(of))
            if at < 0:
                break
        return found[0], found[1], line


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """item, doc_id, license, dice, line of each row of docs(doc_id, text): the best match over the whole text (line -1),
    each of its lines (from 0) and all windows of its words (the line where the window begins); nulls if none reaches
    `least`.

    Ties go to the whole text, then the earlier line, then the template first by name, then the earlier window. Null and empty texts match
    nothing; repeated rows and null ids stay rows; an empty table gives no rows; other columns are ignored. Templates
    are a parameter of a few dozen entries and travel with the code.
    """
    given = templates or TEMPLATES
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("license", pa.string()), ("dice", pa.float64()), ("line", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(given, least)
        seen: dict[str, tuple[float, str] | None] = {}
        for batch in batches:
            out = []
            for text in batch.column(2):
                text = text.as_py() or ""
                lines = text.split("\n")
                found = None
                for k, line in enumerate(lines if len(lines) == 1 else [text, *lines], start=-1):
                    if k < 0 or len(line) > 200:
                        hit = match.best(line)
                    elif line in seen:
                        hit = seen[line]
                    else:
                        if len(seen) > 20_000:
                            seen.clear()
                        hit = seen[line] = match.best(line)
                    if hit and (found is None or hit[0] > found[0]):
                        found = (*hit, k)
                if found is None or found[0] < 1:
                    hit = match.window(text)
                    if hit and (found is None or hit[0] > found[0]):
                        found = hit
                out.append(found or (None, None, None))
            score, name, line = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch([*batch.columns[:2], pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(line, pa.int32())], schema=schema)

    rows = common.rows(docs).select("item", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: common.released(run(batches)), "item long, doc_id long, license string, dice double, line int")
