"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates."""

from __future__ import annotations

import bisect
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Notices of the licence families, as their licensors publish them.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "gfdl": [
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
        "SPDX-License-Identifier: GFDL-1.3-or-later",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "Confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
UNKNOWN = "unknown"
#: What stands around a notice, and prose that uses its words otherwise.
FRAMES = ["{}", "Copyright (c) 2021 Example Authors. {}", "Note: {}", "{} See the file for details.", "The data set was {}", "{} Copyright 2019.", "/* {} */"]
PROSE = [
    "The driver lost his license after the accident and could not work.",
    "The restaurant applied for a liquor license in March.",
    "Permission to enter the building is granted by the office upon request.",
    "The general public was invited to the opening of the library.",
    "Free software is discussed in the next chapter of the course.",
    "The author reserved a table and distributed copies of the program to the guests.",
    "Copyright law was changed by parliament last year.",
    "The conditions of the contract were met without any warranty claim.",
    "A version of the story was published in the public domain journal.",
    "The creative director has common interests with the foundation.",
    "International attribution of the work remains disputed among critics.",
    "She obtained the rights to use the source in her work.",
]
STOP = frozenset("a an and any are as at be been by can could for from has have he her his i if in is it its last may must no not of on one or out over part see she so such than that the their them then there these they this to under up upon use was we were which will with without you your all".split())
#: Width of the hashed features, least calibrated probability and least shared part with a template of a confirmed find.
FEATURES, PROBABLE, CONFIRMED = 1 << 14, 0.6, 0.5
#: A paragraph's words: licence words with at most GAP others between them, and MARGIN words on either side.
GAP, MARGIN = 8, 3

_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(words: list[str], most: int = 3) -> np.ndarray:
    """Hashed word 1- to 3-grams, each once."""
    found = {" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)}
    return np.array(sorted({zlib.crc32(g.encode()) % FEATURES for g in found}), dtype=np.int64)


def _examples(rng: np.random.Generator, each: int = 48) -> tuple[list[list[str]], list[int], list[str]]:
    """Paragraphs of every family (parts of notices in frames, with words lost) and of none."""
    names = [UNKNOWN, *TEMPLATES]
    rows, labels = [], []
    every = [w for t in TEMPLATES.values() for s in t for w in words_of(s)]
    for k, name in enumerate(names):
        sources = PROSE if name == UNKNOWN else TEMPLATES[name]
        for i in range(each * (4 if name == UNKNOWN else 1)):
            s = words_of(FRAMES[int(rng.integers(len(FRAMES)))].format(sources[i % len(sources)]))
            if name == UNKNOWN and i % 3 == 1:  # words of notices, out of order
                s = [every[int(j)] for j in rng.integers(len(every), size=int(rng.integers(1, 12)))]
            elif name == UNKNOWN and i % 3 == 2:  # few words
                s = [s[int(j)] for j in rng.integers(len(s), size=int(rng.integers(1, 5)))]
            elif len(s) > 24 and i % 2:
                at = int(rng.integers(0, len(s) - 16))
                s = s[at : at + int(rng.integers(16, 40))]
            if len(s) > 8 and i % 4 == 3:
                s = [w for w in s if rng.random() > 0.08]
            rows.append(s)
            labels.append(k)
    return rows, labels, names


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    vocabulary: frozenset
    templates: list[list[frozenset]]

    def probabilities(self, words: list[str]) -> np.ndarray:
        z = (self.weights[grams(words)].sum(axis=0) + self.bias) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def confirm(self, family: int, words: list[str]) -> float:
        """Largest part of the paragraph's or a template's word pairs that the other has as well."""
        own = set(zip(words, words[1:], strict=False))
        best = 0.0
        for t in self.templates[family]:
            shared = len(own & t)
            best = max(best, shared / max(1, min(len(own), len(t))))
        return best


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(seed: int = 5) -> Model:
    """Fits the classifier on paragraphs made from the templates and on prose; no row of any table is used.

    Multinomial logistic regression by gradient descent with momentum over hashed word n-grams; a quarter of the paragraphs calibrates the temperature.
    """
    rows, labels, names = _examples(np.random.default_rng(seed))
    x = [grams(r) for r in rows]
    active = np.unique(np.concatenate(x))
    col = np.full(FEATURES, -1)
    col[active] = np.arange(len(active))
    dense = np.zeros((len(x), len(active)), np.float32)
    for i, g in enumerate(x):
        dense[i, col[g]] = 1
    y = np.eye(len(names), dtype=np.float32)[labels]
    fit = np.random.default_rng(seed + 1).random(len(x)) > 0.25
    w, b = np.zeros((len(active), len(names)), np.float32), np.zeros(len(names), np.float32)
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    a, t = dense[fit], y[fit]
    for _ in range(300):
        p = _softmax(a @ w + b) - t
        mw = 0.9 * mw + a.T @ p / len(a) + 1e-4 * w
        mb = 0.9 * mb + p.mean(axis=0)
        w -= 1.0 * mw
        b -= 1.0 * mb
    z, goal = dense[~fit] @ w + b, np.array(labels)[~fit]
    loss = lambda c: -np.log(_softmax(z / c)[np.arange(len(z)), goal] + 1e-9).mean()
    temperature = min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    weights = np.zeros((FEATURES, len(names)), np.float32)
    weights[active] = w
    vocabulary = frozenset(v for t in TEMPLATES.values() for s in t for v in words_of(s) if v not in STOP and len(v) > 1)
    pairs = [[]] + [[frozenset(zip(ws, ws[1:], strict=False)) for ws in map(words_of, t)] for t in TEMPLATES.values()]
    return Model(names, weights, b, float(temperature), vocabulary, pairs)


def paragraphs(text: str):
    """(lower-case text, [(place, line number)]) of each paragraph: lines that follow one another, up to a blank one or one that ends a sentence.

    So a notice that is wrapped over several lines is one paragraph, and notices that are lines of their own are not.
    """
    parts, starts, at = [], [], 0
    for number, line in enumerate(text.split("\n")):
        low = line.lower()
        if low.strip():
            parts.append(low)
            starts.append((at, number))
            at += len(low) + 1
        if parts and (not low.strip() or low.rstrip()[-1] in ".!?"):
            yield "\n".join(parts), starts
            parts, starts, at = [], [], 0
    if parts:
        yield "\n".join(parts), starts


def scan(model: Model, text: str) -> list[tuple[str, float, bool, int, int, int]]:
    """Finds in a text: (family, probability, confirmed, line, first word, word after the last), the words counted within the paragraph."""
    out = []
    for low, starts in paragraphs(text):
        if model.vocabulary.isdisjoint(low.split()) and model.vocabulary.isdisjoint(_WORD.findall(low)):
            continue
        found = list(_WORD.finditer(low))
        words = [m.group() for m in found]
        hits = [i for i, w in enumerate(words) if w in model.vocabulary]
        start = 0
        for k in range(1, len(hits) + 1):
            if k < len(hits) and hits[k] - hits[k - 1] <= GAP:
                continue
            a, z = max(0, hits[start] - MARGIN), min(len(words), hits[k - 1] + 1 + MARGIN)
            first = found[hits[start]].start()
            start = k
            p = model.probabilities(words[a:z])
            best = int(p.argmax())
            if best and p[best] >= PROBABLE:
                sure = model.confirm(best, words[a:z]) >= CONFIRMED
                line = starts[bisect.bisect_right(starts, first, key=lambda x: x[0]) - 1][1]
                out.append((model.names[best], float(p[best]), sure, line, a, z))
    return out


def scan_licences(docs: DataFrame, model: Model | None = None, *, text: str = "text") -> DataFrame:
    """Adds licences: array of struct (family, probability, confirmed, line, start, stop), in the order of the text.

    Of each paragraph of the text (see ``paragraphs``) the licence words (those of templates that are no stop words) with few others between them are what is classified; one
    without such words is unknown. A find has a family's calibrated probability of ``PROBABLE`` or more against all others and unknown; it is confirmed if it shares enough
    word pairs with one of the family's templates. Null and empty texts have no finds. Other columns pass through; one named licences is replaced.
    """
    model = model or train()
    docs = docs.drop("licences")
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), "licences array<struct<family:string,probability:double,confirmed:boolean,line:int,start:int,stop:int>>"])
    kind = pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_()), ("line", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))
    names = ("family", "probability", "confirmed", "line", "start", "stop")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [[dict(zip(names, f, strict=True)) for f in scan(model, t or "")] for t in batch.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "licences"])

    return docs.mapInArrow(run, schema)


def licence_rows(docs: DataFrame) -> DataFrame:
    """Every document with the confirmed families that it names and the number of its finds."""
    from pyspark.sql import functions as F

    out = scan_licences(docs.select("doc_id", "text"))
    sure = F.filter("licences", lambda x: x["confirmed"])
    families = F.array_join(F.sort_array(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",")
    return out.select("doc_id", families.alias("families"), F.size(sure).alias("confirmed"), F.size("licences").alias("finds"))
