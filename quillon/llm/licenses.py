"""License scans: a paragraph classifier over sparse word n-grams, confirmed by templates.

A paragraph is a line with a word.  A multinomial logistic regression over word 1-
to 3-grams gives its family, ``unknown`` (a licence of no known family) or
``none``.  It is trained here on the paragraphs of short licences, the notices
that longer ones ask for, short mentions and SPDX tags of every family, all with
words dropped, changed and added; on those of ``OTHER`` families for ``unknown``;
and on ordinary text.  Its temperature and the probability under which it is not
sure are set on variants held out and on ``STRANGE`` families, which the training
never saw.

Every paragraph is scored.  An upper bound, the sum of the best weights of its
n-grams, settles those that cannot come out as anything but ``none``; it is a
bound, so no other paragraph is lost.  A prediction of a family stands only if
its templates confirm it: most of the paragraph's word pairs are the family's, or
half the pairs of one of its templates lie in the paragraph, or it names the
licence.  What is a licence by the model but not confirmed is ``unknown``.
Neighbouring lines of one family are one finding, so a notice may be wrapped at
any width.

Defined results: a null text has no paragraphs; of families with equal scores the
first by name wins; texts and lines of any length are scanned whole; repeated rows
are scanned alike; an empty table gives an empty table; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import keyed_text, per_batch
from .wordhash import ALNUM, Words, slices

VARIANTS = 8
PASSES = 150
#: Shares of the paragraph's pairs, and of a template's, that confirm a family, and how many pairs the first must be.
OF_PARAGRAPH, OF_TEMPLATE, LEAST_PAIRS = 0.6, 0.5, 4

# Names of licences, notices and the paragraphs of short licence texts, by family.
NAMES = {
    "agpl": ["GNU Affero General Public License", "GNU AGPL", "AGPLv3", "AGPL-3.0-only", "AGPL-3.0-or-later", "Affero GPL"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0", "Apache License", "Apache 2.0"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "New BSD License", "Simplified BSD License", "BSD licence"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 3.0"],
    "cc0": ["CC0 1.0 Universal", "CC0-1.0", "CC0", "Creative Commons Zero", "CC0 Public Domain Dedication"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3", "GNU GPL", "GPLv3", "GPLv2", "GPL-3.0-only", "GPL-2.0-or-later", "GPL version 2", "GPL license"],
    "isc": ["ISC License", "ISC licence", "ISC-licensed"],
    "lgpl": ["GNU Lesser General Public License", "GNU LGPL", "LGPLv3", "LGPLv2.1", "LGPL-2.1-only", "LGPL-3.0-or-later", "Lesser GPL"],
    "mit": ["MIT License", "MIT licence", "The MIT License", "Expat License", "MIT-licensed", "MIT licensed"],
    "mpl": ["Mozilla Public License, version 2.0", "Mozilla Public License", "MPL-2.0", "MPL 2.0"],
    "unlicense": ["Unlicense", "The Unlicense"],
}
#: Names that say nothing without a frame around them, by family.
TAGS = {"mit": ["MIT"], "isc": ["ISC"], "bsd": ["BSD"], "gpl": ["GPL"], "lgpl": ["LGPL"], "agpl": ["AGPL"], "mpl": ["MPL"], "apache": ["Apache"]}
FRAMES = ("Released under the {}.", "Licensed under {}.", "Licensed under the {}", "This work is licensed under a {}.", "This project is licensed under the terms of the {}.", "This project is {} licensed.", "SPDX-License-Identifier: {}", "License: {}", "Distributed under the {}, see the file LICENSE.", "Text available under {}.", "Copyright 2020 the authors, {}.", "under {}", "{}", "available under the {} license", "You may use this under the terms of the {}")
TEXTS = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/"],
    "apache": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "You must give appropriate credit, provide a link to the license, and indicate if changes were made under the Attribution license."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "You may not use the material for commercial purposes under the Attribution-NonCommercial license."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original."],
    "cc0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.", "You should have received a copy of the CC0 Public Domain Dedication along with this software.", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION',
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation",
    ],
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "The contents of this file are subject to the Mozilla Public License Version 1.1; you may not use this file except in compliance with the License."],
    "reserved": ["All rights reserved.", "Copyright 2020 by the authors. All rights reserved.", "No part of this work may be reproduced without the prior written permission of the publisher.", "This document is proprietary and confidential. All rights reserved.", "(c) 2015 by the publisher, all rights reserved", "Copyright (C) 2007 Company, Inc. All rights reserved worldwide."],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ],
}
#: Families that teach the unknown class, and others that set the threshold only.
OTHER = ["zlib License", "Eclipse Public License, version 2.0", "EPL-2.0", "Open Data Commons Open Database License", "ODbL", "SIL Open Font License", "OFL-1.1", "Zlib", "Microsoft Public License", "PostgreSQL License"]
OTHER_TEXTS = ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Usage is governed by the enclosed license agreement.", "The software is licensed, not sold, under the terms of the license agreement.", "Use of this data is subject to the terms of the license of its provider."]
STRANGE = ["Academic Free License", "Common Public License", "Python Software Foundation License", "Ruby License", "LaTeX Project Public License"]
ORDINARY = """the licence plate of the car was under the seat
she was released from work and free to go
all of the version had been reserved for later use
permission to speak was granted by the chair of the meeting
the public may use the general path under the bridge
a copy of the letter and the terms of the sale
his right hand rests on the software manual
the foundation of the house was built in common stone
commercial use of the attribution is a matter for the court
source and binary stars in international waters
he had a license to drive and a permit to fish
the software was slow and the source of the problem was in the code
you should have seen the apache helicopter above the desert
the institute at mit published a paper about the bsd kernel
in no event did the author of the book appear
this work was provided for the use of any person who came by
we grant that the copyright of the song was in dispute
the file was distributed to the members of the general assembly
please see the notes for more details and the list of conditions
the contents of this box are subject to change without notice
by the above name the holder of the ticket may enter
the mozilla browser and the gnu tools were on the disk
of the and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over""".split("\n")


def _plain(text: str) -> list[str]:
    """Words as the scan sees them: runs of ASCII letters, digits and other characters beyond ASCII, in small letters."""
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text).lower().split()


def _hashed(words: list[list[str]]) -> Words:
    (_, run), *rest = list(slices(pa.array([" ".join(w) for w in words], pa.string()), ALNUM))
    assert not rest
    return run


def _grams(run: Words) -> list[np.ndarray]:
    """Hashes of the 1- to 3-grams from each word on."""
    return [run.shingles(k) for k in (1, 2, 3)]


class Model:
    """Weights of the n-grams, the bound, and what confirms a family; small, so it is trained once and sent to the workers."""

    def __init__(self, seed: int = 5):
        rng = random.Random(seed)
        self.families = [*sorted(TEXTS), "unknown", "none"]
        self.n = len(self.families)
        rows: list[tuple[list[str], int]] = []
        ordinary = [_plain(t) for t in ORDINARY]
        extra = sorted({w for t in ordinary for w in t}) + ["2019", "2023", "copyright", "c"]

        def add(text: str, family: str, times: int) -> None:
            rows.extend((self._variant(_plain(text), rng, extra), self.families.index(family)) for _ in range(times))

        for family, texts in TEXTS.items():
            for text in texts:
                add(text, family, VARIANTS)
                # wrapped notices: runs of some words of the text
                w = _plain(text)
                rows += [(w[a : a + n], self.families.index(family)) for n in (8, 12) for a in range(0, max(0, len(w) - n), 5)]
        for family, names in NAMES.items():
            for frame in FRAMES:
                for name in rng.sample(names, min(len(names), 4)):
                    add(frame.format(name), family, 1)
                for name in TAGS.get(family, ()):
                    if frame not in ("{}", "under {}", "Copyright 2020 the authors, {}."):
                        add(frame.format(name), family, 2)
        for text in OTHER_TEXTS:
            add(text, "unknown", VARIANTS)
        for frame in FRAMES:
            for name in OTHER:
                add(frame.format(name), "unknown", 1)
            add(frame.format("".join(rng.choices("abcdefghiklmnoprstu", k=6)) + " License"), "unknown", 2)
        none = self.families.index("none")
        for _ in range(40 * VARIANTS):
            w = [x for t in rng.sample(ordinary, 2) for x in t]
            a = rng.randrange(len(w) - 4)
            rows.append((self._variant(w[a : a + rng.randint(3, 25)], rng, extra), none))
        # the words of licences in no order, among words never seen, are ordinary text too
        salad = sorted({w for w, _ in rows for w in w})
        rows += [([w, *more], none) for w in salad for more in ([], [rng.choice(salad)], [rng.choice("xyz") + w])]
        for _ in range(120 * VARIANTS):
            w = rng.choices(salad, k=rng.randint(1, 4)) + ["".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 9))) for _ in range(rng.randint(0, 10))]
            rng.shuffle(w)
            rows.append((w, none))
        rows = [r for r in rows if r[0]]
        rng.shuffle(rows)
        run = _hashed([w for w, _ in rows])
        line = np.repeat(np.arange(len(rows)), np.diff(run.first))
        at, gram = self._within(run, line)
        self.vocabulary, column, times = np.unique(gram, return_inverse=True, return_counts=True)
        often = times > 2
        at, column, self.vocabulary = at[often[column]], (np.cumsum(often) - 1)[column[often[column]]], self.vocabulary[often]
        held = len(rows) // 5
        x = np.zeros((len(rows), len(self.vocabulary) + 1), np.float32)
        x[line[at], column] = 1
        x[:, -1] = 1
        x /= self._norm(np.diff(run.first))[:, None]
        x[:, -1] = 0.3
        y = np.eye(self.n, dtype=np.float32)[[f for _, f in rows]]
        w = np.zeros((x.shape[1], self.n), np.float32)
        speed = np.zeros_like(w)
        for _ in range(PASSES):
            p = self._softmax(x[held:] @ w)
            speed = 0.9 * speed + x[held:].T @ (y[held:] - p) / (len(rows) - held) - 2e-5 * w
            w += 4.0 * speed
        self.weights, self.bias = w[:-1], 0.3 * w[-1]
        logits, truth = x[:held] @ w, y[:held].argmax(axis=1)
        grid = np.geomspace(0.25, 4, 17)
        self.temperature = float(min(grid, key=lambda t: -np.log(self._softmax(logits / t)[np.arange(held), truth] + 1e-9).mean()))
        #: how much of a probability for a licence of any kind only one in 100 ordinary texts held out gets
        self.doubt = float(max(0.5, np.quantile(1 - self._softmax(logits[truth == none] / self.temperature)[:, none], 0.99)))
        #: what an n-gram, and no n-gram, can add to any class over ``none``
        self.most = np.maximum(0, (self.weights - self.weights[:, none : none + 1]).max(axis=1))
        self.start = float(np.delete(self.bias - self.bias[none], none).max())
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        p = self._softmax(logits / self.temperature)
        sure, licence = p.max(axis=1), truth < self.n - 2
        strange = [self.probabilities(f.format(s))[: self.n - 2].max() for s in STRANGE for f in FRAMES if f != "{}"]
        # as much as most families unseen get, but not more than nearly all known ones do
        self.threshold = float(min(np.quantile(sure[licence & (p.argmax(axis=1) == truth)], 0.05), np.quantile(strange, 0.9)))
        pairs = lambda text: np.unique(_hashed([_plain(text)]).shingles(2)[: len(_plain(text)) - 1])
        self.templates = {f: [pairs(t) for t in texts if len(_plain(t)) > 2] for f, texts in TEXTS.items()}
        self.pairs = {f: np.unique(np.concatenate(some)) for f, some in self.templates.items()}
        #: names as hashes of all their words, by length
        self.names: dict[int, dict[int, str]] = {}
        tagged = [(f, frame.format(t)) for f, tags in TAGS.items() for t in tags for frame in ("SPDX-License-Identifier: {}", "License: {}", "{} license", "{} licensed", "{} licence", "licensed under {}", "licensed under the {}")]
        for family, name in [*((f, x) for f, some in NAMES.items() for x in some), *tagged, ("reserved", "all rights reserved")]:
            words = _plain(name)
            self.names.setdefault(len(words), {})[int(_hashed([words]).shingles(len(words))[0])] = family

    @staticmethod
    def _variant(words: list[str], rng: random.Random, extra: list[str]) -> list[str]:
        out = [w if rng.random() > 0.04 else rng.choice(extra) for w in words if len(words) < 8 or rng.random() > 0.05]
        for _ in range(rng.choice((0, 0, 1, 2, 5))):
            out.insert(rng.choice((0, len(out))), rng.choice(extra))
        return out

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    @staticmethod
    def _norm(words: np.ndarray) -> np.ndarray:
        """Length of a paragraph's vector, by its number of words."""
        return np.sqrt(np.maximum(1, 3 * words - 3)).astype(np.float32)

    @staticmethod
    def _within(run: Words, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every n-gram inside a line, none twice in a line."""
        at, gram = [], []
        for k, grams in enumerate(_grams(run), 1):
            here = np.flatnonzero(line[k - 1 :] == line[: len(line) - k + 1]) if len(line) >= k else np.zeros(0, np.int64)
            at.append(here)
            gram.append(grams[here])
        at, gram = np.concatenate(at), np.concatenate(gram)
        order = np.lexsort((gram, line[at]))
        at, gram = at[order], gram[order]
        same = (np.diff(line[at], prepend=-1) == 0) & (gram == np.concatenate([gram[:1] + np.uint64(1), gram[:-1]])) if len(at) else np.zeros(0, bool)
        return at[~same], gram[~same]

    def scores(self, run: Words, line: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
        """(lines that may be more than ``none``, the probabilities of their classes)."""
        at, column = [], []
        for k, grams in enumerate(_grams(run), 1):
            if len(line) < k:
                continue
            grams = grams[: len(line) - k + 1]
            here = np.flatnonzero(self.bits[(grams >> np.uint64(48)).astype(np.int64)] & (line[k - 1 :] == line[: len(line) - k + 1]))
            place = np.searchsorted(self.vocabulary, grams[here])
            place[place == len(self.vocabulary)] = 0
            ok = self.vocabulary[place] == grams[here]
            at.append(here[ok])
            column.append(place[ok])
        at, column = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, column))
        cell = np.unique(line[at] * len(self.vocabulary) + column)
        of, column = cell // len(self.vocabulary), cell % len(self.vocabulary)
        norm = self._norm(np.bincount(line, minlength=lines))
        may = np.bincount(of, weights=self.most[column], minlength=lines) / norm + self.start > 0
        some = np.flatnonzero(may)
        z = np.zeros((len(some), self.n), np.float32)
        mine = may[of]
        np.add.at(z, np.searchsorted(some, of[mine]), self.weights[column[mine]])
        return some, self._softmax((z / norm[some][:, None] + self.bias) / self.temperature)

    def probabilities(self, paragraph: str) -> np.ndarray:
        run = _hashed([_plain(paragraph)])
        line = np.zeros(len(run.hashes), np.int64)
        some, p = self.scores(run, line, 1)
        return p[0] if len(some) else np.eye(self.n)[-1]

    def named(self, run: Words, a: int, b: int) -> set[str]:
        """Families that words a to b name; a longer name hides the shorter ones that lie in it."""
        found: list[tuple[int, int, str]] = []
        for k in sorted(self.names, reverse=True):
            if b - a >= k:
                window = object.__new__(Words)
                window.hashes = run.hashes[a:b]
                for i, h in enumerate(window.shingles(k)[: b - a - k + 1].tolist()):
                    if (f := self.names[k].get(h)) and not any(x <= i and i + k <= y for x, y, _ in found):
                        found.append((i, i + k, f))
        return {f for _, _, f in found}

    def verdict(self, run: Words, a: int, b: int, p: np.ndarray) -> str:
        """Of words a to b, with the probabilities of their classes."""
        best = self.families[int(p.argmax())]
        if best == "none":
            return "none"
        names = self.named(run, a, b)
        if len(names) == 1:
            return names.pop()
        if best in TEXTS:
            window = object.__new__(Words)
            window.hashes = run.hashes[a:b]
            own = np.unique(window.shingles(2)[: b - a - 1])
            shared = np.isin(own, self.pairs[best]).sum()
            if shared >= LEAST_PAIRS and shared >= OF_PARAGRAPH * len(own) and p.max() >= self.threshold:
                return best
            if any(np.isin(t, own).sum() >= OF_TEMPLATE * len(t) for t in self.templates[best]) and (p.max() >= self.threshold or best in names):
                return best
        return "unknown" if b - a > 1 and p[:-1].sum() >= self.doubt else "none"

    def classify(self, paragraph: str) -> str:
        """A family, ``unknown`` or ``none``."""
        words = _plain(paragraph)
        if not words:
            return "none"
        run = _hashed([words])
        some, p = self.scores(run, np.zeros(len(words), np.int64), 1)
        return self.verdict(run, 0, len(words), p[0]) if len(some) else "none"

    def findings(self, run: Words) -> tuple[np.ndarray, list[list[tuple[int, str]]]]:
        """(paragraphs of each text, for each text its findings as (paragraph, family))."""
        texts = len(run.first) - 1
        text = np.repeat(np.arange(texts), np.diff(run.first))
        # numbers of lines; two apart from text to text, so that lines of two texts are no neighbours
        row = np.searchsorted(np.flatnonzero(run.raw == 10), run.lo) + 2 * text
        rows, line = np.unique(row, return_inverse=True)
        start = np.searchsorted(line, np.arange(len(rows) + 1))
        of = text[start[:-1]] if len(rows) else np.zeros(0, np.int64)
        first = np.searchsorted(of, np.arange(texts + 1))
        out: list[list[tuple[int, str]]] = [[] for _ in range(texts)]
        some, p = self.scores(run, line, len(rows))
        verdicts = [(i, v) for i, q in zip(some.tolist(), p) if (v := self.verdict(run, int(start[i]), int(start[i + 1]), q)) != "none"]
        at = 0
        while at < len(verdicts):
            end = at + 1
            while end < len(verdicts) and rows[verdicts[end][0]] == rows[verdicts[end - 1][0]] + 1:
                end += 1
            last = "none"
            for i, v in self._together(run, start, verdicts[at:end]):
                if v != last or v == "unknown":
                    out[of[i]].append((int(i - first[of[i]]), v))
                last = v
            at = end
        return np.diff(first), out

    def _together(self, run: Words, start: np.ndarray, lines: list[tuple[int, str]]) -> list[tuple[int, str]]:
        """Neighbouring lines with their verdicts; those that the notice they make up together holds have its family."""
        if len({v for _, v in lines}) == 1:
            return lines
        a, b = int(start[lines[0][0]]), int(start[lines[-1][0] + 1])
        whole = object.__new__(Words)
        whole.hashes = run.hashes[a:b]
        some, p = self.scores(whole, np.zeros(b - a, np.int64), 1)
        notice = self.verdict(whole, 0, b - a, p[0]) if len(some) else "none"
        if notice not in TEXTS:
            # lines that name one licence between them
            names = {f for f in (v for _, v in lines) if f in TEXTS}
            if len(names) != 1:
                return lines
            notice = names.pop()
        out = []
        for i, v in lines:
            a, b = int(start[i]), int(start[i + 1])
            if v != notice and not self.named(run, a, b) - {notice}:
                part = object.__new__(Words)
                part.hashes = run.hashes[a:b]
                own = part.shingles(2)[: b - a - 1]
                if np.isin(own, self.pairs[notice]).sum() >= OF_PARAGRAPH * len(own):
                    v = notice
            out.append((i, v))
        return out


@lru_cache(maxsize=2)
def model(seed: int = 5) -> Model:
    return Model(seed)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 5) -> DataFrame:
    """Per document: key, n_paragraphs, n_license (findings of a family), n_unknown, families (sorted, comma-joined), paragraphs (findings as number:family, a wrapped notice with its first line's number)."""
    slim = keyed_text(docs, key, text)
    known = docs.sparkSession.sparkContext.broadcast(model(seed))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for _, run in slices(batch.column(1), ALNUM):
            for n, found in zip(*known.value.findings(run)):
                families = sorted({f for _, f in found} - {"unknown"})
                rows.append((int(n), sum(f != "unknown" for _, f in found), sum(f == "unknown" for _, f in found), ",".join(families), ",".join(f"{i}:{f}" for i, f in found)))
        c = list(zip(*rows))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, k) for v, k in zip(c, kinds)]], names=[key, "n_paragraphs", "n_license", "n_unknown", "families", "paragraphs"])

    return per_batch(slim, step, f"`{key}` {slim.schema[0].dataType.simpleString()}, n_paragraphs long, n_license long, n_unknown long, families string, paragraphs string")
