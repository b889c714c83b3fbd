"""License scans: which licences the paragraphs of a document name.

A paragraph is a run of lines without a blank one, so notices wrapped at any width are whole.  Where word pairs of a notice
stand in it, the words around them are a passage, and passages are classified: features are words and word pairs (a sparse
dictionary of those seen in training; which pairs tell a notice is counted over every paragraph) of a multinomial logistic regression, trained on notices of each family, whole and with
words dropped, and on passages of a bounded sample of documents as the unknown class.  A temperature, fitted on whole notices
that a first fit hasn't seen and on passages held back, calibrates the probabilities.  A family is reported only if its
probability reaches ``min_probability`` (or half of that, where the passage holds its name) and a comparison confirms it: at
least ``min_overlap`` of the pairs of one of its notices must occur in the passage, or of the passage's in the notice.  Where a
passage tells the version of a GNU licence, that version decides.  A passage may name several families.

Cases: null and empty texts have no paragraphs and no licences.  Repeated rows keep a row each.  Long texts are
scanned whole.  With no documents to sample, the unknown class is fitted on the built-in sentences alone.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, extended, fresh, slices

WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
#: Documents whose paragraphs stand for the unknown class, at most about this many, and paragraphs of each.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS = 400, 8
UNKNOWN = "unknown"
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "This project is released under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "This project is licensed under the terms of the MIT license.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "Licensed under the GNU General Public License, version 2.",
        "Licensed under the GPL v2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "GPL-1.0": ["Licensed under the GNU General Public License, version 1.", "SPDX-License-Identifier: GPL-1.0-only"],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the LGPL.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the AGPL v3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "all-rights-reserved": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without permission."],
}
#: Names by which a passage may tell a family beside its likeliest one.
NAMES = {"Apache-2.0": "apache license|apache 2.0", "MIT": "mit license|mit and|the mit", "BSD": "bsd license|bsd 2|bsd 3", "MPL-2.0": "mozilla public license|mpl 2.0", "LGPL": "lgpl|lesser general public", "AGPL-3.0": "agpl|affero general public", "CC0": "cc0"}
_GNU = re.compile(r"(?:general public license|\bgpl)(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?v?([123])(?:\.0)?\b")
_PLAIN = [
    "The license of the driver was checked at the border.", "All rights and duties were reserved for the members.", "The general public was under the impression that the work was free.",
    "Released in the spring, the record was licensed abroad.", "This work is under review.", "Version 2.0 of the plan was released under pressure.", "The Apache helicopter landed.", "He studied at MIT.",
]


def _pairs_of(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def features(words: list[str]) -> list[str]:
    return [*words, *_pairs_of(words)]


def pairs(text: str) -> set[str]:
    words = WORD.findall(text.lower())
    return set(_pairs_of(words)) or set(words)


NOTICES = {c: [pairs(t) for t in ts] for c, ts in TEMPLATES.items()}
NOTICE_PAIRS = {p for ts in NOTICES.values() for t in ts for p in t}
MIN_OVERLAP = 0.6


def holds_notice(own: set[str]) -> bool:
    return any(len(own & p) >= MIN_OVERLAP * len(p) for ts in NOTICES.values() for p in ts)


def count_pairs(texts) -> Counter:
    """How many of the paragraphs that hold no notice have each pair of a notice, and, under None, how many there are."""
    out = Counter()
    for t in texts:
        own = pairs(t) & NOTICE_PAIRS
        if not own or not holds_notice(own):
            out.update(own)
            out[None] += 1
    return out


class LicenceModel:
    def __init__(self, negatives: list[str], seed: int = 3, often: Counter | None = None):
        """often: count_pairs of all paragraphs; of the negatives, if not given."""
        self.classes = [*TEMPLATES, UNKNOWN]
        self.pairs = NOTICES
        self.min_probability, self.min_overlap = 0.6, MIN_OVERLAP
        negatives = [t for t in negatives if not holds_notice(pairs(t))]  # the sample holds notices too
        often = count_pairs(_PLAIN * 4) + (count_pairs(negatives) if often is None else often)
        #: Pairs of notices that ordinary text hardly has; passages are the words around them.
        self.telling = {p for p in NOTICE_PAIRS if often[p] <= 0.002 * often[None]}
        rows = [(c, k, t) for c, ts in TEMPLATES.items() for k, t in enumerate(ts)]
        passages = [*_PLAIN * 4, *(" ".join(w[a:b]) for t in negatives for w in [WORD.findall(t.lower())] for a, b in self.passages(w) if not self.confirmed(set(_pairs_of(w[a:b]))))]
        passages += [x for x in negatives[::2] if not self.confirmed(pairs(x))]
        notices = {f for _, _, t in rows for f in features(WORD.findall(t.lower()))}
        kept = Counter(f for t in passages for f in set(features(WORD.findall(t.lower()))))
        self.place = {f: i for i, f in enumerate(sorted(notices | {f for f, n in kept.items() if n > 2}))}
        # a first fit without one whole notice of each family that has three, and without a fifth of the passages, for the temperature
        self.temperature = 1.0
        unseen = {(c, k) for c, k, _ in rows if len(TEMPLATES[c]) > 2 and k == 2}
        self._fit([r for r in rows if r[:2] not in unseen], [t for i, t in enumerate(passages) if i % 5], np.random.default_rng(seed))
        held = [(self.classes.index(c), t) for c, k, t in rows if (c, k) in unseen] + [(len(self.classes) - 1, t) for t in passages[::5][:200]]
        self.temperature = self._calibrate([t for _, t in held], np.array([c for c, _ in held]))
        self._fit(rows, passages, np.random.default_rng(seed))

    def passages(self, words: list[str], gap: int = 10, around: int = 3) -> list[tuple[int, int]]:
        """Begin and end of the words around telling pairs that stand close to one another."""
        spots = [i for i, p in enumerate(_pairs_of(words)) if p in self.telling]
        out: list[list[int]] = []
        for i in spots:
            if out and i - out[-1][1] <= gap:
                out[-1][1] = i
            else:
                out.append([i, i])
        return [(max(0, a - around), b + 2 + around) for a, b in out]

    def _vector(self, words: list[str]) -> list[int]:
        return [self.place[f] for f in set(features(words)) if f in self.place] + [len(self.place)]

    def _fit(self, notices: list[tuple], plain: list[str], rng, epochs: int = 12) -> None:
        rows, y = [], []
        for c, _, t in notices:
            words = WORD.findall(t.lower())
            for k in range(12):
                rows.append(self._vector(words if k < 4 else [w for w in words if rng.random() < 0.9]))
                y.append(self.classes.index(c))
        rows += [self._vector(WORD.findall(t.lower())) for t in plain]
        y += [len(self.classes) - 1] * len(plain)
        self.weights = np.zeros((len(self.place) + 1, len(self.classes)))
        squares = np.full(self.weights.shape, 1e-2)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                z = self.weights[rows[i]].sum(axis=0)
                q = np.exp(z - z.max())
                q /= q.sum()
                q[y[i]] -= 1
                g = q + 1e-4 * self.weights[rows[i]]
                squares[rows[i]] += g * g
                self.weights[rows[i]] -= 0.3 * g / np.sqrt(squares[rows[i]])

    def _logits(self, words: list[str]) -> np.ndarray:
        return self.weights[self._vector(words)].sum(axis=0) / self.temperature

    def _calibrate(self, texts: list[str], y: np.ndarray) -> float:
        z = np.stack([self._logits(WORD.findall(t.lower())) for t in texts])

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

        return min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)

    def confirmed(self, own: set[str], classes: list[str] | None = None) -> bool:
        return any(len(own & p) >= self.min_overlap * len(p) or (len(own) > 3 and len(own & p) >= self.min_overlap * len(own)) for c in classes or TEMPLATES for p in self.pairs[c])

    def probabilities(self, words: list[str]) -> np.ndarray:
        z = self._logits(words)
        q = np.exp(z - z.max())
        return q / q.sum()

    def families(self, paragraph: str) -> list[tuple[str, float, int]]:
        """Families that a paragraph names, each with its highest probability and the word (from 0) where it is first told."""
        words = WORD.findall(paragraph.lower())
        out: dict[str, tuple[float, int]] = {}

        def add(c: str, p: float, at: int) -> None:
            old = out.get(c, (0.0, at))
            out[c] = max(old[0], p), old[1]

        for a, b in self.passages(words):
            at = min(a + 3, b - 2) if a else next(i for i, p in enumerate(_pairs_of(words)) if p in self.telling)
            part = words[a:b]
            own, text, q = set(_pairs_of(part)), " ".join(part), self.probabilities(part)
            versions = {f"GPL-{v}.0" for v in _GNU.findall(text)}
            for i in np.argsort(-q, kind="stable")[:4]:
                c = self.classes[i]
                if c == UNKNOWN:
                    continue
                named = c in NAMES and re.search(NAMES[c], text)
                if q[i] < (0.5 if named else 1.0) * self.min_probability and not (named and q[-1] < 0.5):
                    continue
                if c.startswith("GPL-") and versions:
                    for v in versions & set(TEMPLATES):
                        add(v, float(q[[self.classes.index(x) for x in TEMPLATES if x.startswith("GPL-")]].sum()), at)
                elif named or self.confirmed(own, [c]):
                    add(c, float(q[i]), at)
        return [(c, p, at) for c, (p, at) in sorted(out.items())]

    def predict(self, text: str) -> tuple[str, float]:
        """The likeliest family, or unknown with its probability."""
        found = self.families(text)
        if found:
            return max(found, key=lambda x: x[1])[:2]
        words = WORD.findall(text.lower())
        return UNKNOWN, min((float(self.probabilities(words[a:b])[-1]) for a, b in self.passages(words)), default=1.0)


def paragraphs(text: str | None):
    """The first line (from 0) and the lines of each run of lines without a blank one."""
    held, begin = [], 0
    for i, line in enumerate((text or "").split("\n")):
        if line and not line.isspace():
            if not held:
                begin = i
            held.append(line)
        elif held:
            yield begin, held
            held = []
    if held:
        yield begin, held


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = SAMPLE_DOCS) -> LicenceModel:
    d = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    rows = sorted(bounded_sample(d, ["i", "t"], limit, "t").collect(), key=lambda r: (r.i is None, r.i or 0, r.t))
    found = [[" ".join(p) for _, p in paragraphs(r.t)] for r in rows]
    return LicenceModel([x for own in found for x in own[:: max(1, len(own) // SAMPLE_PARAGRAPHS)]], often=corpus_pairs(docs, text))


def corpus_pairs(docs: DataFrame, text: str = "text") -> Counter:
    """count_pairs of every paragraph of docs; a row a task and pair of a notice is all that is shuffled."""

    def run(batches):
        n = Counter()
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                n.update(count_pairs(" ".join(lines) for _, lines in paragraphs(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["pair", "n"])

    rows = docs.select(F.col(text).alias("t")).mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return Counter({r.pair: r.n for r in rows})


def scan_licences(docs: DataFrame, model: LicenceModel, text: str = "text") -> DataFrame:
    """docs with n_paragraphs and licences: line (from 0, where it is told), family and probability of each family that a paragraph names.  No shuffle."""
    names = [fresh(docs, c) for c in ("n_paragraphs", "licences")]
    cols, place = docs.columns, docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    kind = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64())]))

    def run(batches):
        m = shared.value
        for b in slices(batches):
            n, found = [], []
            for t in b.column(place).to_pylist():
                count, got = 0, []
                for i, lines in paragraphs(t):
                    count += 1
                    for family, q, at in m.families(" ".join(lines)):
                        line = 0
                        while line + 1 < len(lines) and at >= (own := len(WORD.findall(lines[line]))):
                            at, line = at - own, line + 1
                        got.append({"line": i + line, "family": family, "probability": q})
                n.append(count)
                found.append(got)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(found, kind)], names=[*cols, *names])

    return docs.mapInArrow(run, extended(docs, f"{names[0]} long, {names[1]} array<struct<line:int,family:string,probability:double>>"))


def op4_licences(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan_licences(docs, train(docs))
    return out.select("doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licences"), F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x.family))), ",").alias("families"), F.round(F.array_max(F.transform("licences", lambda x: x.probability)), 6).alias("probability"))
