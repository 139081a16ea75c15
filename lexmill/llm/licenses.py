"""License scans: texts against templates by Dice coefficient over word bigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.textkit import LOWER, blocks, mix, word_hashes

# Public license notices. Fixed values.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}

_WORDS = np.zeros(256, bool)
_WORDS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def bigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the bigrams of normalised words by their second words, of these words after an empty one, and the place of each one's first byte.

    Words are runs of letters and digits (bytes above 127 count as letters), A-Z as a-z; punctuation and white space, line ends too, part them.
    Bigrams don't cross texts; a text's first word follows an empty word.
    """
    low = LOWER[data]
    inside = _WORDS[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[at] = True
    begin = inside & np.concatenate([[True], ~inside[:-1]])[: len(low)] | inside & edge[:-1]
    end = inside & (np.concatenate([~inside[1:], [True]])[: len(low)] | edge[1:])
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    word = word_hashes(low, start, stop)
    row = np.searchsorted(at, start, "right")
    before = np.zeros(len(word), np.uint64)
    before[1:] = np.where(row[1:] == row[:-1], word[:-1], np.uint64(0))
    return mix(before * np.uint64(0x9E3779B97F4A7C15) ^ word), mix(word.copy()), start


def _set(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return np.unique(bigrams(data, np.array([0, len(data)]))[0])


class Matcher:
    """Templates by size, with the bounds that a window's set must keep to reach the threshold.

    2 * min(a, b) / (a + b) bounds the coefficient, so with threshold t the sizes of a pair stand in a ratio between t / (2 - t)
    and its inverse, and that share of a template's bigrams must occur; other templates are never compared.
    """

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        made = sorted(((len(s), name, s) for name, texts in templates.items() for s in map(_set, texts)), key=lambda x: x[:2])
        self.sizes = np.array([m[0] for m in made])
        self.names, self.sets, self.threshold = [m[1] for m in made], [m[2] for m in made], threshold
        self.known = np.unique(np.concatenate(self.sets)) if made else np.zeros(0, np.uint64)
        self.ratio = threshold / (2 - threshold)
        #: Words of the stretches that are looked at first; a match has no gap of ``apart`` unknown words.
        self.span = int(min(5, self.sizes[0])) if made else 5
        self.apart = int((1 / self.ratio - self.ratio) * self.sizes[-1]) + 2 if made else 0

    def held(self, gram: np.ndarray) -> np.ndarray:
        return self.known[np.minimum(np.searchsorted(self.known, gram), len(self.known) - 1)] == gram if len(self.known) else np.zeros(len(gram), bool)

    def dense(self, flag: np.ndarray) -> np.ndarray:
        """Places from which as large a share of ``span`` words is known as a match has on the whole."""
        total = np.concatenate([[0], np.cumsum(flag)])
        return np.flatnonzero(total[self.span :] - total[: -self.span] >= max(1, int(self.span * self.ratio))) if len(flag) >= self.span else np.zeros(0, np.int64)

    def windows(self, gram: np.ndarray, first: np.ndarray, known: np.ndarray) -> list[tuple[int, int, float, str]]:
        """``(start, end, dice, name)`` of windows of words that match and don't overlap: those that share the most bigrams, then the closest, then the first by template's name.

        The best window of a template starts and ends with a bigram of it, at the border of a run of them; its first word follows an empty one.
        """
        dense = self.dense(known | self.held(first))
        if not len(dense):
            return []
        cut = np.flatnonzero(np.diff(dense) > self.apart + self.span) + 1
        found, sets = [], [set(x.tolist()) for x in self.sets]
        for part in np.split(dense, cut):
            low, high = max(0, int(part[0]) - self.apart), min(len(gram), int(part[-1]) + self.span + self.apart)
            own, lead = gram[low:high], first[low:high]
            for t, template in enumerate(self.sets):
                f, st = np.isin(own, template), np.isin(lead, template)
                if np.count_nonzero(np.isin(template, own)) + 1 < self.ratio * len(template) - 1e-9:
                    continue
                after = np.append(f[1:], False)
                starts = np.flatnonzero(st | (after & ~f))
                ends = np.unique(np.concatenate([np.flatnonzero(f & ~after), np.flatnonzero(st)])) + 1
                for a in starts.tolist():
                    have, shared, at, best = set(), 0, a, None
                    for e in ends[np.searchsorted(ends, a, "right") :].tolist():
                        new = (set(own[max(at, a + 1) : e].tolist()) | ({int(lead[a])} if at == a else set())) - have
                        at = e
                        have |= new
                        if len(have) * self.ratio > len(template) + 1e-9:
                            break
                        shared += len(new & sets[t])
                        dice = 2 * shared / (len(have) + len(template))
                        if dice >= self.threshold - 1e-12 and (best is None or dice > best[1]):
                            best = (shared, dice, e)
                    if best:
                        found.append((-best[0], -best[1], self.names[t], low + a, low + best[2]))
        out: list[tuple[int, int, float, str]] = []
        for _, dice, name, a, e in sorted(found):
            if all(e <= x or a >= y for x, y, _, _ in out):
                out.append((a, e, -dice, name))
        return sorted(out)


SPAN = "array<struct<license:string,dice:double,start:int,end:int>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """``(id, license, dice, n_spans, spans)``, one row per row.

    A template matches a window of words of any length, anywhere in the text and across its lines, whose Dice coefficient over word bigrams reaches the threshold.
    ``spans`` has the windows with their lines (0-based, end exclusive); they don't overlap, but may share a line. ``license`` is that of the span with the largest coefficient, then the first. Null and
    empty texts, and texts that match nothing, have null license and dice and no spans; an empty table gives an empty result; rows that repeat give the same; further columns
    are ignored.
    """
    matcher = Matcher(TEMPLATES if templates is None else templates, threshold)
    sent = docs.sparkSession.sparkContext.broadcast(matcher)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for rows, data, at in blocks(batches):
            gram, first, place = bigrams(data, at)
            known = own.held(gram)
            limit = np.searchsorted(place, at)
            # texts without a dense stretch are done at once; one may be seen across two texts, which costs a look
            dense = own.dense(known | own.held(first))
            likely = np.unique(np.searchsorted(limit, np.concatenate([dense, dense + own.span - 1]), "right") - 1)
            spans = [[] for _ in range(rows.num_rows)]
            for i in likely.tolist():
                a, b = limit[i], limit[i + 1]
                breaks = at[i] + np.flatnonzero(data[at[i] : at[i + 1]] == 10)
                line = np.searchsorted(breaks, place[a:b], "left")
                spans[i] = [{"license": name, "dice": dice, "start": int(line[x]), "end": int(line[y - 1]) + 1} for x, y, dice, name in own.windows(gram[a:b], first[a:b], known[a:b])]
            best = [max(s, key=lambda x: (x["dice"], -x["start"]), default=None) for s in spans]
            kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([x and x["license"] for x in best], pa.string()), pa.array([x and x["dice"] for x in best], pa.float64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, kind)], names=["id", "license", "dice", "n_spans", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, license string, dice double, n_spans long, spans {SPAN}").withColumnRenamed("id", id_col)
