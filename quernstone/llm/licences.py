"""Licence scans: passages of a text against licence templates, by the Dice coefficient over word bigrams.

Text and templates are normalised alike: lower case, words of letters and digits only. A passage is a run of words; its
score with a template is 2 * common / (its distinct bigrams + the template's distinct bigrams). Size bounds prune: at a
threshold t a passage shares at least t / (2 - t) of the template's bigrams and has between t / (2 - t) and
(2 - t) / t times as many, so a template is a candidate for a text only if the whole text holds that many of its
bigrams, and passages stay within the upper bound. The best passages that don't overlap are reported. Texts are
scanned whole, wherever lines break, so a licence inside a longer text is found too.

Defined results: a null, empty or one-word text has no passage; of overlapping passages the one of higher score stays,
then that of the longer template, then the first; a licence that occurs twice is reported twice; rows with repeated or
null ids are scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship, table

THRESHOLD = 0.8
WORD = re.compile(r"[^\W_]+")

#: Published licence texts and the usual notices that name a licence.
TEMPLATES = {
    "Apache-2.0 notice": ["Licensed under the Apache License, Version 2.0."],
    "Apache-2.0 header": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ],
    "MIT notice": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, '
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and "
        "to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
    ],
    "BSL-1.0": [
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, '
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative "
        "works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ],
    "GPL-3.0 notice": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "GPL-3.0-or-later header": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ],
    "MPL-2.0 header": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY-NC-4.0 notice": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0 notice": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "GPL-2.0-or-later header": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details."
    ],
    "LGPL-2.1-or-later header": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU Lesser General Public License for more details."
    ],
    "AGPL-3.0-or-later header": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU Affero General Public License for more details."
    ],
    "EPL-2.0 header": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "CC0-1.0 notice": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. "
        "You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/."
    ],
    "CC-BY-SA-4.0 notice": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "OFL-1.1 header": ["This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at: http://scripts.sil.org/OFL"],
    "WTFPL": [
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. "
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."
    ],
    "BSD disclaimer": [
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ],
}


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Scanner:
    def __init__(self, templates: dict[str, list[str]], threshold: float) -> None:
        self.t = threshold
        split = [(name, words_of(text)) for name, texts in templates.items() for text in texts]
        self.names = [name for name, _ in split]
        self.sizes = np.array([len(set(zip(w, w[1:]))) for _, w in split])
        words = sorted({x for _, w in split for x in w})
        self.word = {x: i for i, x in enumerate(words)}
        pairs = sorted({p for _, w in split for p in zip(w, w[1:])})
        self.pair = np.full((len(words) + 1, len(words) + 1), -1, dtype=np.int32)  # the last word: any other
        for i, (a, b) in enumerate(pairs):
            self.pair[self.word[a], self.word[b]] = i
        self.member = np.zeros((len(pairs), len(split)), dtype=bool)
        for k, (_, w) in enumerate(split):
            for a, b in zip(w, w[1:]):
                self.member[self.pair[self.word[a], self.word[b]], k] = True
        self.least = np.ceil(self.sizes * threshold / (2 - threshold) - 1e-9).astype(int)
        self.most = np.floor(self.sizes * (2 - threshold) / threshold + 1e-9).astype(int)

    def passages(self, codes: list[int], hits: np.ndarray, pairs: np.ndarray, candidates: np.ndarray) -> list[tuple]:
        """(score, template's size, start word, end word, template) of passages from one hit to another that reach the threshold; of each start and template the best.

        Only where a bigram comes up for the first time since the start can the score change. So starts are taken from the
        last to the first, with the first places since the start of all bigrams in a linked list: a start walks no more
        places than a passage may have distinct bigrams, however often the text repeats itself.
        """
        own = [[] for _ in codes]
        for place, pair in zip(hits.tolist(), pairs.tolist()):
            own[place] = candidates[self.member[pair, candidates]].tolist()
        found, first, after, before, head = [], {}, [-1] * len(codes), [-1] * len(codes), -1
        for i in range(len(codes) - 1, -1, -1):
            j = first.get(codes[i], -1)
            if j >= 0:  # no longer the first place of this bigram
                x, y = before[j], after[j]
                if x >= 0:
                    after[x] = y
                else:
                    head = y
                if y >= 0:
                    before[y] = x
            first[codes[i]], after[i] = i, head
            if head >= 0:
                before[head] = i
            before[i], head = -1, i
            for k in own[i]:
                size, most, common, inside, best, at = int(self.sizes[k]), int(self.most[k]), 0, 0, None, i
                while at >= 0 and inside < most:
                    inside += 1
                    if k in own[at]:
                        common += 1
                        score = 2 * common / (inside + size)
                        if score >= self.t and (best is None or score > best[0]):
                            best = (score, size, i, at + 2, self.names[k])
                        if common == size:
                            break
                    at = after[at]
                if best:
                    found.append(best)
        return found

    def scan(self, text: str | None) -> list[dict]:
        words = words_of(text)
        other = len(self.word)
        ids = np.fromiter((self.word.get(w, other) for w in words), dtype=np.int32, count=len(words))
        if len(ids) < 2:
            return []
        pairs = self.pair[ids[:-1], ids[1:]]
        hits = np.flatnonzero(pairs >= 0)
        pairs = pairs[hits]
        candidates = np.flatnonzero(self.member[np.unique(pairs)].sum(axis=0) >= self.least)
        if not len(candidates):
            return []
        number: dict[str, int] = {}
        place = [number.setdefault(w, len(number)) for w in words]
        codes = [a * len(number) + b for a, b in zip(place, place[1:])]
        starts, out = [], []  # of the passages that stay, by start
        for p in sorted(self.passages(codes, hits, pairs, candidates), key=lambda p: (-p[0], -p[1], p[2], p[4])):
            at = bisect(starts, p[2])
            if (at == 0 or out[at - 1][3] <= p[2]) and (at == len(out) or p[3] <= out[at][2]):
                starts.insert(at, p[2])
                out.insert(at, p)
        return [{"licence": p[4], "dice": p[0], "start": p[2], "end": p[3]} for p in out]


PASSAGES = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_licences(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and passages (array of licence, dice, start and end in words) of each row of docs."""
    ship(docs.sparkSession)
    known = templates or TEMPLATES

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known, threshold)
        for batch in batches:
            found = [scanner.scan(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found, PASSAGES)], ["_id", "passages"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"_id {kind}, passages array<struct<licence: string, dice: double, start: long, end: long>>").withColumnRenamed("_id", id_col)


def op2_licence_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents"))
    names = F.transform("passages", lambda p: p["licence"])
    return found.select(
        "doc_id",
        F.size("passages").cast("long").alias("n_passages"),
        F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("licences"),
        F.coalesce(F.array_max(F.transform("passages", lambda p: p["dice"])), F.lit(0.0)).alias("best_dice"),
        F.to_json("passages").alias("passages"),
    )


QUERIES = {"op2_licence_scan": op2_licence_scan}
