"""Licence scans: a trained paragraph classifier confirmed by templates.

Paragraphs (runs of lines between blank lines, and each line by itself) are scored by logistic regressions over hashed
word 1- to 3-grams: whole where they have LONGEST words at most, and in overlapping windows of each of the sizes in
WINDOWS that they exceed, so that a notice inside a long line is scored without most of the words around it. A first
regression tells licence text from other text; for what it takes for a licence, a second one tells the family. Both are
trained here, on paragraphs and windows made from the notices below (parts, joined lines, changed years and names,
surrounded by other words), on notices of licences that are no family (UNLISTED), on sentences that use the same
words for other things (PLAIN), and on lines and windows of the corpus. Temperatures, fitted on examples kept apart and
on licences that no example was made of (HELD), calibrate the probabilities.

A family stands only if both agree. The second regression gives it a probability of LIKELY at least, and the text holds
one of its templates: the share of the template's word 3-grams found in it (or all its words, for short notices) reaches
CONFIRM, and so does that of the 3-grams that no other licence here has. Of several such families the likeliest stands.
What the classifier takes for a licence without a family that stands is of the class "unknown", from a probability of
SURE_UNKNOWN on.

A whole paragraph's finding has its bytes; a window's has those of the 3-grams found. Findings of windows that overlap
better ones go, as do those of a family that their short paragraph has as a whole. Windows that overlap or touch and
hold no confirmed notice are one finding.

The corpus part of the training sample is bounded by SAMPLE_LINES distinct pieces of lines, chosen by hash from all pieces
of all whole texts; every document is scanned whole. Weights have a fixed size. Documents are never shuffled.

Nulls: a null or empty text has no licence: licence is null, n_licences 0. Repeated rows are scanned each. Words are
scored STEP at a time, whatever the length of a line. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U

BUCKETS = 1 << 20
SAMPLE_LINES = 6000
WINDOWS = ((4, 1), (8, 2), (16, 4), (40, 8))  # words of a window, words between starts; a notice of the difference fits whole
LONGEST = 40  # words; longer paragraphs are scored in windows only
STEP = 1 << 16  # words scored at once
SURE = 0.5  # calibrated probability from which on a paragraph is taken for a licence
SURE_UNKNOWN = 0.95  # the same where no template confirms it
CONFIRM = 0.6
LIKELY = 0.1  # probability of a family among licences; twice that of one of 20 drawn by lot

#: Notices and paragraphs of well-known public licences, by family.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Licensed under the BSD 3-Clause License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Creative Commons Attribution-NonCommercial 4.0 International License",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International License"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "cc0": (
        "This work is dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which is available at https://www.eclipse.org/legal/epl-2.0",),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software",
    ),
    "wtfpl": ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",),
    "proprietary": ("All rights reserved.", "Copyright 2020 Example Corporation. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
}
#: Notices of licences that are no family here, to learn what an unknown licence looks like.
UNLISTED = (
    "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.",
    "This package is free software; you may redistribute and/or modify it under the terms of the Artistic License 2.0.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "This source file is subject to version 3.01 of the PHP license, that is bundled with this package in the file LICENSE.",
    "Licensed under the Microsoft Public License (Ms-PL).",
    "This software is licensed under the Academic Free License version 3.0.",
    "Use of this software is governed by the Business Source License included in the LICENSE file.",
    "Licensed to the Foundation under one or more contributor license agreements.",
    "The Licensor hereby grants You a worldwide, royalty-free, non-exclusive licence to use the Work in any circumstances and for all usage.",
    "You are granted a limited, non-transferable, revocable licence to install and use one copy of the Product.",
    "Distributed under the terms of the Open Software License.",
    "SPDX-License-Identifier: CDDL-1.0",
    "SPDX-License-Identifier: Artistic-2.0",
    "SPDX-License-Identifier: AFL-3.0",
    "SPDX-License-Identifier: MS-PL",
    "SPDX-License-Identifier: LicenseRef-Proprietary",
    "Licensed under the Sample Company Community License.",
)
#: As above, kept out of the examples that train, to calibrate on.
HELD = (
    "Licensed under the European Union Public Licence 1.2.",
    "This program is made available under the terms of the Common Public License v1.0 that accompanies this distribution.",
    "This file is licensed under the terms of the Q Public License, version 1.0.",
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3.",
    "SPDX-License-Identifier: NCSA",
    "SPDX-License-Identifier: EUPL-1.1",
    "Licensed under the Other Example Source Available License.",
    "This software may be used and redistributed for research under the conditions of the accompanying licence agreement.",
)
#: Sentences that speak of licences, rights and copies without being notices.
PLAIN = (
    "She renewed her driving licence at the town hall and paid the fee.",
    "The restaurant lost its liquor license after a series of complaints.",
    "He asked for permission to leave the room, and it was granted.",
    "A copy of the report was sent to every member of the committee.",
    "Everyone has the right to freedom of opinion and expression.",
    "The court reserved its judgment on the matter until the spring.",
    "Children under twelve are free of charge and may use the pool without restriction.",
    "The government published a list of conditions that must be met before the merger.",
    "The software was distributed to schools across the country last year.",
    "Modern versions of the program are free for students and teachers.",
    "The author retains a copy of the source for his own purposes.",
    "This warranty covers parts and labour for two years from the date of purchase.",
    "The public library is open to any person with a valid card.",
    "The foundation published the terms of the grant in March.",
    "They modified the engine and sold it under another name.",
    "The common people of the region made their living from the sea.",
    "Creative writing courses are offered in the commons building.",
    "We obtained written consent from all of the patients in the study.",
    "The university of Massachusetts is a public institution, MIT a private one.",
    "The Apache are a group of peoples of the American Southwest.",
    "Mozilla released a new version of its browser on Tuesday.",
    "The eclipse was seen by the general public in most of Europe.",
    "All passengers must provide identification before boarding.",
    "The company provides the service as is customary in the trade.",
    "No event shall be held in the park without the mayor's approval.",
    "Copyright law is taught in the second year.",
    "The album was released under the name of the band's drummer.",
    "He was charged with unauthorized entry and held liable for the damages.",
    "A limited number of copies of the novel were sold.",
    "The licensed electrician checked the work.",
)
#: SPDX identifiers by family, besides those above.
SPDX = {
    "mit": "MIT MIT-0",
    "apache-2.0": "",
    "gpl": "GPL-3.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-2.0 GPL-3.0-only GPL-3.0",
    "lgpl": "LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-2.1 LGPL-3.0-only LGPL-3.0-or-later LGPL-3.0",
    "agpl": "AGPL-3.0-only AGPL-3.0-or-later AGPL-3.0",
    "bsd": "BSD-3-Clause BSD-2-Clause BSD-4-Clause 0BSD BSD-2-Clause-Patent",
    "cc-by-nc": "CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-3.0",
    "cc-by": "CC-BY-4.0 CC-BY-3.0",
    "cc-by-sa": "CC-BY-SA-4.0 CC-BY-SA-3.0",
    "cc-by-nd": "CC-BY-ND-4.0 CC-BY-ND-3.0",
    "cc0": "CC0-1.0",
    "mpl": "MPL-2.0 MPL-1.1",
    "epl": "EPL-2.0 EPL-1.0",
    "isc": "ISC",
    "unlicense": "Unlicense",
    "zlib": "Zlib",
    "boost": "BSL-1.0",
    "wtfpl": "WTFPL",
}
TEMPLATES = {f: (*TEMPLATES.get(f, ()), *(f"SPDX-License-Identifier: {x}" for x in SPDX.get(f, "").split())) for f in (*TEMPLATES, *(f for f in SPDX if f not in TEMPLATES))}
FAMILIES = ("unknown", *TEMPLATES)
WORD = common.class_table(lambda b: b >= 128 or chr(b).isalnum())


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each word hash."""
    g = h[: max(0, len(h) - n + 1)]
    for j in range(1, n):
        g = common.mix(g * U(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
    return (g & U(BUCKETS - 1)).astype(np.int64)


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(starts, ends, hashes, row) of the words; one that only repeats the word before it in its row says nothing and is left out."""
    s, e, woff = common.words(buf, off, WORD)
    row = np.repeat(np.arange(len(off) - 1), np.diff(woff))
    if not len(s):
        return s, e, np.zeros(0, np.uint64), row
    h = common.word_hashes(buf, s, e)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return s[new], e[new], h[new], row[new]


def _features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, its paragraph) for 1- to 3-grams."""
    _, _, h, row = _words(buf, off)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, rows = [], []
    for n in (1, 2, 3):
        g = _buckets(h, n)
        same = row[: len(g)] == row[n - 1 :]
        grams.append(g[same])
        rows.append(row[: len(g)][same])
    return np.concatenate(grams), np.concatenate(rows)


@dataclass
class Model:
    screen: np.ndarray  # (BUCKETS,): licence text against other text
    screen_bias: float
    scale: np.ndarray  # by size of text, as in WINDOWS: what the screen's score is multiplied by,
    shift: np.ndarray  # and what is added, to be the log odds of licence text
    used: np.ndarray  # the buckets that the families' weights are of, ascending
    weights: np.ndarray  # (families, used buckets)
    bias: np.ndarray
    temperature: float

    def families(self, text: str) -> np.ndarray:
        """P(family) of a text that is of a licence; the first is that of none of them."""
        bucket, _ = _features(*_pack([text]))
        at = np.minimum(np.searchsorted(self.used, bucket), len(self.used) - 1)
        at = at[self.used[at] == bucket]
        return _softmax((self.weights[:, at].sum(1) / math.sqrt(max(1, len(bucket))) + self.bias)[None] / self.temperature)[0]

    def licences(self, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """P(licence) of each of the spans first..last of the word hashes, of 1 to LONGEST words, ordered by first."""
        out = np.zeros(len(first))
        for lo in range(0, len(h), STEP):
            i, j = np.searchsorted(first, [lo, lo + STEP])
            if i == j:
                continue
            a, b = first[i:j] - lo, last[i:j] - lo
            part = h[lo : lo + STEP + LONGEST]
            b1, b2, b3 = (_buckets(part, n) for n in (1, 2, 3))
            size = b - a
            count = np.sqrt(np.maximum(1, size + np.maximum(0, size - 1) + np.maximum(0, size - 2)))
            w2, w3 = np.zeros(len(part)), np.zeros(len(part))
            w2[: len(b2)], w3[: len(b3)] = self.screen[b2], self.screen[b3]
            both = w2 + w3
            c = np.concatenate([[0], np.cumsum(self.screen[b1] + both, dtype=np.float64)])
            # n-grams that leave the span at its end don't count
            total = c[b] - c[a] - both[b - 1] - np.where(size > 1, w3[np.maximum(0, b - 2)], 0)
            at = _size_class(size)
            out[i:j] = _sigmoid((total / count + self.screen_bias) * self.scale[at] + self.shift[at])
        return out


def _size_class(words: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted([w for w, _ in WINDOWS], words), len(WINDOWS) - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _pack(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = [t.encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def _examples(others: list[str], seed: int = 7) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(texts, kind, kept apart, notice): examples of families and of unknown licences (kind 0), and others (kind -1)."""
    r = np.random.Generator(np.random.PCG64(seed))
    texts, kinds, apart, notices = [], [], [], []
    corpus = [x for line in others for x in line.split()] or "some other words here".split()

    def pick(n: int) -> str:
        at = int(r.integers(0, max(1, len(corpus) - n)))
        return " ".join(corpus[at : at + n])

    def add(text: str, kind: int, held: bool = False) -> None:
        texts.append(text)
        kinds.append(kind)
        apart.append(held or bool(r.random() < 0.2))

    def varied(template: str, kind: int, copies: int, held: bool = False) -> None:
        words = template.split()
        for i in range(copies):
            lo = int(r.integers(0, max(1, len(words) // 4))) if i % 4 == 3 else 0
            body = " ".join(words[lo:])
            body = re.sub(r"\b20\d\d\b", str(int(r.integers(1990, 2030))), body)
            body = [body, body.lower(), f"{pick(3)} {body}", f"{body} {pick(8)}"][i % 4 if i else 0]
            add(body, kind, held)
            # and as a window meets it, somewhere among other words
            window = next((w for w, step in WINDOWS if w - step + 1 >= len(words)), LONGEST)
            before = int(r.integers(0, max(0, window - len(words)) + 1))
            add(f"{pick(before)} {body} {pick(max(0, window - len(words) - before))}", kind, held)
            if len(words) > 8:  # and as a smaller one does, in part
                size = int(r.choice([w for w, _ in WINDOWS if w <= len(words)] or [len(words)]))
                at = int(r.integers(0, len(words) - size + 1))
                if size >= 8:
                    add(" ".join(words[at : at + size]), kind, held)

    made = [(t, k, 8 if t.startswith("SPDX") else 20, False) for k, family in enumerate(FAMILIES[1:], 1) for t in TEMPLATES[family]]
    made += [(t, 0, 20, False) for t in UNLISTED] + [(t, 0, 10, True) for t in HELD]
    for i, of in enumerate(made):
        varied(*of)
        notices += [i] * (len(texts) - len(notices))
    n = len(texts)
    for x in others:
        add(x, -1)
        words = x.split()
        for size, _ in WINDOWS[:-1]:
            if len(words) > size:
                at = int(r.integers(0, len(words) - size + 1))
                add(" ".join(words[at : at + size]), -1)
    for i in range(max(0, n - len(others)) if others else 0):  # few lines count as much as many
        add(others[i % len(others)], -1)
    for i in range(n):
        add(pick(WINDOWS[i % len(WINDOWS)][0]), -1)
    for sentence in PLAIN:
        words = sentence.split()
        for i in range(12):
            add([sentence, sentence.lower(), f"{pick(4)} {sentence} {pick(4)}"][i % 3], -1)
        for size in (3, 4, 8):
            for at in range(max(0, len(words) - size + 1)):
                for _ in range(3):
                    add(" ".join(words[at : at + size]), -1)
    single = [*corpus, *(x for ts in TEMPLATES.values() for t in ts for x in t.split())]
    for _ in range(n):  # nor do one or two words by themselves, or a few in any order
        add(" ".join(single[int(i)] for i in r.integers(0, len(single), r.integers(1, 3) if r.random() < 0.7 else r.integers(3, 9))), -1)
    notice = [x for ts in (*TEMPLATES.values(), UNLISTED) for t in ts for x in t.split()]
    for word in sorted({x.lower() for x in notice}):
        for _ in range(12):
            add(word, -1)
    for i in range(2 * n):  # words that no training text has speak for nothing, nor do single words of notices among them
        size, some = (int(r.integers(1, 30)), 0.0) if i % 4 == 0 else (WINDOWS[i % 4 - 1][0], r.random() / 2)
        add(" ".join(notice[int(r.integers(0, len(notice)))] if r.random() < some else "".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9))) for _ in range(size)), -1)
    return texts, np.array(kinds), np.array(apart), np.array(notices + [-1] * (len(texts) - n))


def _sample_lines(docs: DataFrame, most: int) -> list[str]:
    """At most `most` distinct pieces (of LONGEST words or fewer) of lines, those of the least hashes among all of all texts."""

    def run(batches):
        best: dict[int, str] = {}
        for _, buf, off in common.parts(batches, "text"):
            s, e, woff = common.words(buf, off, common.NOT_SPACE)
            if not len(s):
                continue
            # a piece starts with a row or line, and after LONGEST words of one
            breaks = np.concatenate([[0], np.cumsum(buf == 10)])
            line = breaks[s]
            row = np.repeat(np.arange(len(off) - 1), np.diff(woff))
            new = np.ones(len(s), bool)
            new[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            place = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
            first = np.flatnonzero(place % LONGEST == 0)
            last = np.append(first[1:], len(s)) - 1
            first, last = first[last > first], last[last > first]
            c, q = common.rolling(buf)
            key = common.mix((c[e[last]] - c[s[first]]) * q[s[first]])
            for i in np.argsort(key)[:most] if len(key) > most else range(len(key)):
                best[int(key[i])] = buf[s[first[i]] : e[last[i]]].tobytes().decode("utf-8", "replace")
            if len(best) > 4 * most:
                best = {k: best[k] for k in sorted(best)[:most]}
        best = {k: best[k] for k in sorted(best)[:most]}
        yield pa.RecordBatch.from_arrays([pa.array([k - (1 << 63) for k in best], pa.int64()), pa.array(list(best.values()), pa.string())], names=["k", "piece"])

    pieces = docs.select("text").mapInArrow(run, "k long, piece string").groupBy("k").agg(F.min("piece").alias("piece"))
    return [r.piece for r in pieces.orderBy("k").limit(most).collect()]


def _fit(bucket: np.ndarray, row: np.ndarray, kind: np.ndarray, classes: int, weight: np.ndarray, epochs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets that occur, weights (classes, those buckets), bias) of a softmax regression by full-batch AdaGrad steps."""
    used, at = np.unique(bucket, return_inverse=True)
    n = len(kind)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))
    w, b, grad2 = np.zeros((classes, len(used))), np.zeros(classes), np.full((classes, len(used)), 1e-3)
    for _ in range(epochs):
        z = np.stack([np.bincount(row, w[k][at], minlength=n) for k in range(classes)], 1) * scale[:, None] + b
        d = _softmax(z)
        d[np.arange(n), kind] -= 1
        d *= weight[:, None]
        for k in range(classes):
            g = np.bincount(at, (d[:, k] * scale)[row], minlength=len(used)) + 1e-5 * w[k]
            grad2[k] += g * g
            w[k] -= 0.5 * g / np.sqrt(grad2[k])
        b -= 0.1 * d.sum(0)
    return used, w.astype(np.float32), b


def _scores(bucket: np.ndarray, row: np.ndarray, n: int, used: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))
    at = np.minimum(np.searchsorted(used, bucket), len(used) - 1)
    known = used[at] == bucket
    return np.stack([np.bincount(row[known], w[k][at[known]], minlength=n) for k in range(len(w))], 1) * scale[:, None] + b


def _temperature(z: np.ndarray, kind: np.ndarray, weight: np.ndarray) -> float:
    """The temperature of the least weighted loss on examples kept apart."""
    loss = lambda t: -(weight * np.log(np.maximum(_softmax(z / t)[np.arange(len(kind)), kind], 1e-12))).sum()
    return float(min(np.geomspace(0.03, 8, 40), key=loss))


def _odds(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(scale, shift) of a logistic fit of y on scores z, by Newton steps; both classes count alike, as in training.

    The shift is held near 0: far scores of a size that are all of one class would else let it run off.
    """
    a = np.stack([z, np.ones_like(z)], 1)
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    beta, hold = np.array([1.0, 0.0]), np.array([0.1, 0.1 + 0.02 * len(y)])
    for _ in range(80):
        p = _sigmoid(a @ beta)
        grad = a.T @ (w * (p - y)) + hold * (beta - np.array([1.0, 0.0]))
        hess = (a * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(hold)
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
    return max(0.1, float(beta[0])), float(beta[1])


def train(docs: DataFrame, epochs: int = 50, sample_lines: int = SAMPLE_LINES) -> Model:
    # lines that are partly notices teach nothing about other text
    known = frozenset().union(*(_grams(t) for ts in (*TEMPLATES.values(), UNLISTED, HELD) for t in ts))
    others = []
    for x in _sample_lines(docs, sample_lines):
        grams = _grams(x)
        shared = len(grams & known)
        if not shared or (10 * shared < 3 * len(grams) and _best(x, CONFIRM)[0] == "unknown"):
            others.append(x)
    texts, kind, apart, notice = _examples(others)
    bucket, row = _features(*_pack(texts))

    def part(chosen: np.ndarray):
        place = np.cumsum(chosen) - 1
        inside = chosen[row]
        return bucket[inside], place[row[inside]], int(chosen.sum())

    # licence text counts as much as other text, and each family alike
    is_licence = (kind >= 0).astype(int)
    balance = lambda k: (1 / np.maximum(1, np.bincount(k)))[k]
    x, y, n = part(~apart)
    used, w, b = _fit(x, y, is_licence[~apart], 2, balance(is_licence[~apart]), epochs)
    screen, screen_bias = np.zeros(BUCKETS, np.float32), float(b[1] - b[0])
    screen[used] = w[1] - w[0]
    x, y, n = part(apart)
    z = _scores(x, y, n, used, (w[1] - w[0])[None], np.array([screen_bias]))
    words = np.maximum(1, np.array([len(t.split()) for t in texts]))[apart]
    at, seen = _size_class(words), is_licence[apart]
    odds = [_odds(z[at == c, 0], seen[at == c]) for c in range(len(WINDOWS))]

    def alike(chosen: np.ndarray) -> np.ndarray:
        """Weights by which each family counts alike and, in it, each notice: a tag no less than a page."""
        each = balance(notice[chosen])
        return each / np.bincount(kind[chosen], each)[kind[chosen]]

    mine = kind >= 0
    x, y, n = part(mine & ~apart)
    # families that share most of a notice's words take more steps to part than licences from other text
    used, w, b = _fit(x, y, kind[mine & ~apart], len(FAMILIES), alike(mine & ~apart) / len(FAMILIES), 4 * epochs)
    x, y, n = part(mine & apart)
    t = _temperature(_scores(x, y, n, used, w, b), kind[mine & apart], alike(mine & apart))
    return Model(screen, screen_bias, *(np.array(x) for x in zip(*odds, strict=True)), used, w, b, t)


# ---------------------------------------------------------------- confirmation


def _grams(text: str) -> frozenset:
    w = re.findall(r"[^\W_]+", text.lower())
    n = 3 if len(w) >= 3 else max(1, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def _template_grams() -> dict[str, list[tuple[frozenset, frozenset]]]:
    """By family, each template's 3-grams, and those of them that no other family and no unlisted licence has."""
    of = {f: [g for t in ts if (g := _grams(t))] for f, ts in (*TEMPLATES.items(), ("", (*UNLISTED, *HELD)))}
    common_to = {f: frozenset().union(*(g for other, gs in of.items() if other != f for g in gs)) for f in TEMPLATES}
    return {f: [(g, g - common_to[f]) for g in of[f]] for f in TEMPLATES}


_TEMPLATE_GRAMS = _template_grams()


def _matches(paragraph: str) -> dict[str, tuple[float, int, int, int, int]]:
    """By family, of its best template: (share, n-grams found, first and last word of those, found less twice the missing)."""
    w = re.findall(r"[^\W_]+", paragraph.lower())
    have: dict[tuple, list[int]] = {}
    for n in (1, 2, 3):
        for i in range(len(w) - n + 1):
            have.setdefault(tuple(w[i : i + n]), []).append(i)
    out = {}
    for family, templates in _TEMPLATE_GRAMS.items():
        best = (0.0, 0, 0, 0, -(1 << 30))
        for t, own in templates:
            found = [g for g in t if g in have]
            share = min(len(found) / len(t), sum(g in have for g in own) / len(own) if own else 1.0)
            if found and (share >= CONFIRM, 3 * len(found) - 2 * len(t)) > (best[0] >= CONFIRM, best[4]):
                best = (share, len(found), min(have[g][0] for g in found), max(have[g][-1] + len(g) for g in found), 3 * len(found) - 2 * len(t))
        out[family] = best
    return out


def confirmed(paragraph: str, family: str) -> float:
    """The largest share of one of the family's templates that the paragraph holds."""
    return _matches(paragraph)[family][0]


def _paragraphs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(starts, ends) of each line, and (first, last) line of each paragraph: those with one break between them."""
    line_break = np.array([b != 10 for b in range(256)])
    s, e, loff = common.words(buf, off, line_break)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(loff))
    joined = np.zeros(len(s), bool)  # a line that goes on from the one before: one break between them
    joined[1:] = (doc[1:] == doc[:-1]) & (s[1:] - e[:-1] == 1)
    first = np.flatnonzero(~joined)
    return s, e, first, np.append(first[1:], len(s))[: len(first)] - 1


def _spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word hashes, and by span to score, ordered: first word, behind the last word, first byte, behind the last byte, window?"""
    ws, we, h, _ = _words(buf, off)
    s, e, first, last = _paragraphs(buf, off)
    many = last > first
    s2, e2 = np.concatenate([s, s[first[many]]]), np.concatenate([e, e[last[many]]])
    a, b = np.searchsorted(ws, s2), np.searchsorted(ws, e2)
    whole = (b > a) & (b - a <= LONGEST)
    spans = [(a[whole], b[whole], s2[whole], e2[whole], np.zeros(int(whole.sum()), bool))]
    a, b = np.searchsorted(ws, s[first]), np.searchsorted(ws, e[last])  # a long line's windows are among its paragraph's
    for size, step in WINDOWS:
        x, y = a[b - a > size], b[b - a > size]
        n = -(-(y - x - size) // step) + 1
        at = np.repeat(x - step * (np.cumsum(n) - n), n) + step * np.arange(n.sum())
        at = np.minimum(at, np.repeat(y - size, n))
        spans.append((at, at + size, ws[at], we[at + size - 1], np.ones(len(at), bool)))
    cols = [np.concatenate(c) for c in zip(*spans, strict=True)]
    order = np.argsort(cols[0], kind="stable")
    return h, *(c[order] for c in cols)


def _best(text: str, confirm: float, likely: dict[str, float] | None = None) -> tuple[str, float, int, int, int]:
    """(family or unknown, share, n-grams found, first and last word) of the template that a text holds most of.

    With probabilities of the families, only those of LIKELY or more may stand, and the likeliest that is confirmed does.
    """
    matches = _matches(text)
    stands = {f: m[0] >= confirm and (likely is None or likely[f] >= LIKELY) for f, m in matches.items()}
    family = max(matches, key=lambda f: (stands[f], likely[f] if likely and stands[f] else 0, matches[f][4], matches[f][0]))
    return (family if stands[family] else "unknown", *matches[family][:4])


def _core(text: str, first: int, last: int, start: int) -> tuple[int, int]:
    """The bytes of the words first..last of a text that starts at byte start."""
    at = [m.span() for m in re.finditer(r"[^\W_]+", text)][first:last]
    return (start + len(text[: at[0][0]].encode()), start + len(text[: at[-1][1]].encode())) if at else (start, start)


def _overlaps(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether any of the disjoint, ordered spans overlaps start..end."""
    i = bisect_left(spans, (start, start))
    return (i < len(spans) and spans[i][0] < end) or (i > 0 and spans[i - 1][1] > start)


def _add(spans: list[tuple[int, int]], start: int, end: int) -> None:
    """Unites a span with the disjoint, ordered ones."""
    i = bisect_left(spans, (start, start))
    if i and spans[i - 1][1] > start:
        i -= 1
    j = i
    while j < len(spans) and spans[j][0] < end:
        start, end, j = min(start, spans[j][0]), max(end, spans[j][1]), j + 1
    spans[i:j] = [(start, end)]


def _resolve(wholes: list[tuple], windows: list[tuple]) -> list[dict]:
    """Findings of one document. Each is (family, start, end, probability, share, n-grams found, core start, core end).

    wholes are paragraphs and lines; of windows the start and end are those of the window, the core that of the words found.
    """
    # a paragraph's finding goes where one of its lines has the same family already
    out = [f for f in wholes if not any(g[1:3] != f[1:3] and g[1] >= f[1] and g[2] <= f[2] and (g[0] == f[0] or f[0] == "unknown") for g in wholes)]
    taken: list[tuple[int, int]] = []
    ranges: dict[str, list] = {}
    for f in out:
        _add(ranges.setdefault(f[0], []), f[1], f[2])
        if f[0] != "unknown":
            _add(taken, f[6], f[7])
    known = [f for f in windows if f[0] != "unknown"]
    for f in sorted(known, key=lambda f: (-f[5], f[7] - f[6], -f[3])):
        if _overlaps(taken, f[6], f[7]) or _overlaps(ranges.get(f[0], []), f[6], f[7]):
            continue
        _add(taken, f[6], f[7])
        out.append((f[0], f[6], f[7], *f[3:]))
    out = [f for f in out if f[0] != "unknown" or not _overlaps(taken, f[1], f[2])]
    held: list[tuple[int, int]] = []
    for f in out:
        _add(held, f[1], f[2])
    groups: list[list] = []  # windows that overlap or touch: [end, windows]
    for f in sorted(windows, key=lambda f: f[1]):
        if groups and f[1] <= groups[-1][0] + 1:
            groups[-1][0] = max(groups[-1][0], f[2])
            groups[-1][1].append(f)
        else:
            groups.append([f[2], [f]])
    for end, group in groups:
        if all(f[0] == "unknown" for f in group) and not _overlaps(held, group[0][1], end):
            out.append(("unknown", group[0][1], end, *max(group, key=lambda f: f[3])[3:]))
    return [dict(zip(("family", "start", "end", "probability", "confirmation"), f[:5], strict=True)) for f in sorted(out, key=lambda f: f[1:3])]


def scan(docs: DataFrame, model: Model, sure: float = SURE, confirm: float = CONFIRM) -> DataFrame:
    """doc_id, licence (the family of the first finding; null for none), n_licences, families, and the findings.

    A finding is (family, start, end, probability, confirmation): bytes of the text; family "unknown" where no likely family
    is confirmed by a template in what the classifier took for a licence. The probability is that of the family, for unknown ones of a licence.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    finding = pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64()), ("confirmation", pa.float64())])

    def run(batches):
        m = shared.value
        for part, buf, off in common.parts(batches, "text"):
            wholes: list[list] = [[] for _ in range(len(off) - 1)]
            windows: list[list] = [[] for _ in range(len(off) - 1)]
            h, first, last, start, end, window = _spans(buf, off)
            p = m.licences(h, first, last)
            for i in np.flatnonzero(p >= sure):
                d = int(np.searchsorted(off, start[i], "right")) - 1
                text = buf[start[i] : end[i]].tobytes().decode("utf-8", "replace")
                likely = dict(zip(FAMILIES, m.families(text).tolist(), strict=True))
                name, share, n, x, y = _best(text, confirm, likely)
                if name == "unknown" and p[i] < max(sure, SURE_UNKNOWN):
                    continue
                of = likely[name]
                (windows if window[i] else wholes)[d].append((name, *(int(v - off[d]) for v in (start[i], end[i])), float(p[i] * of if name != "unknown" else p[i]), float(share), n, *_core(text, x, y, int(start[i] - off[d]))))
            found = [_resolve(x, y) if x or y else [] for x, y in zip(wholes, windows, strict=True)]
            known = [[f for f in x if f["family"] != "unknown"] for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"],
                    pa.array([k[0]["family"] if k else ("unknown" if x else None) for k, x in zip(known, found, strict=True)], pa.string()),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([",".join(sorted({f["family"] for f in x})) for x in found], pa.string()),
                    pa.array(found, pa.list_(finding)),
                ],
                names=["doc_id", "licence", "n_licences", "families", "findings"],
            )

    schema = "doc_id long, licence string, n_licences long, families string, findings array<struct<family:string,start:long,end:long,probability:double,confirmation:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
