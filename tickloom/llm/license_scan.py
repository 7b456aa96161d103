"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line of a text; its words are runs of letters and digits with A to Z in lower case. Features are the words and word
pairs that occur in the templates, and the share of words that do not. A logistic regression over the families and the class
`unknown` is fitted on variants of the templates (words lost, lines cut, other words around), against a bounded sample of the
corpus's own paragraphs. Held-out paragraphs calibrate it: a temperature for the probabilities, and the least probability that
lets almost no held-out unknown paragraph through. A family is reported only if a template of it confirms the paragraph: most of
the template's word pairs stand in the paragraph, or nearly all of the paragraph's in the template, and no other family's fits as well.

Only paragraphs with LEAST_SEEDS rare word pairs of templates are scored; without them no template can confirm one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import U64, Texts, Words, mixed, pieces

#: Fixed texts: the notices by which works declare a license, by family.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
    ],
    "Apache-1.1": [
        "Licensed under the Apache License, Version 1.1.",
        "Licensed under the Apache Software License, Version 1.1.",
        "SPDX-License-Identifier: Apache-1.1",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "Licensed under the GNU AGPL v3.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GNU GPL v3.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Licensed under the GNU GPL v2.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "CC-BY-NC-SA": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-ND": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ],
    "CC0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
    ],
}
#: Sentences about licenses that are no license, for the unknown class.
OTHERWISE = [
    "You need a license to drive a car in this country.",
    "The agency renewed its license last year under new terms and conditions.",
    "Version 2.0 of the report was released in May.",
    "The work was published by the foundation under the direction of the author.",
    "Permission to enter the building is granted by the office.",
    "All rights reserved.",
    "The public library is open to any person free of charge.",
    "Use of the parking lot is subject to the following conditions.",
    "The creative commons room was renovated for four weeks.",
    "Students of MIT released a new study.",
]
UNKNOWN = "unknown"
#: The classifier learns from about so many paragraphs of the corpus, and so many variants of each template.
SAMPLE, VARIANTS = 2000, 24
STEPS, RATE, PENALTY = 150, 4.0, 1e-5
LEAST_SEEDS = 2
#: Shares of word pairs by which a template confirms a paragraph: of the template's, or of the paragraph's.
COVERED, CONTAINED, LEAST_PAIRS = 0.6, 0.8, 3

_SPLIT = np.ones(256, bool)
_SPLIT[np.r_[48:58, 65:91, 97:123, 128:256]] = False


def _pairs(h: np.ndarray) -> np.ndarray:
    return mixed(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])


def _hashed(texts: list[str]) -> list[np.ndarray]:
    w = Words(Texts(pa.array(texts, pa.large_string())), spaces=_SPLIT)
    return [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


class Scanner:
    """Features, weights, calibration and templates; small, and sent to the workers."""

    def __init__(self, sample: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.families = sorted(TEMPLATES)
        templates = {f: _hashed(TEMPLATES[f]) for f in self.families}
        self.pairs = {f: [np.unique(_pairs(h)) for h in hs] for f, hs in templates.items()}
        self.words = np.unique(np.concatenate([h for hs in templates.values() for h in hs]))
        self.features = np.union1d(self.words, np.concatenate([p for ps in self.pairs.values() for p in ps]))
        others = [h for h in _hashed(sample) if len(h) and not any(self.similarity(h, f) >= 0.5 for f in self.families)] + _hashed(OTHERWISE) * 5
        # seeds: pairs of template words of which the sample seldom has one
        common = np.concatenate(others) if others else np.empty(0, U64)
        seen = np.searchsorted(np.sort(common), self.words, "right") - np.searchsorted(np.sort(common), self.words, "left")
        rare = set(self.words[seen <= max(100, len(common) // 1000)].tolist())
        self.seeds = np.unique(np.concatenate([p for hs in templates.values() for h in hs for p in [_pairs(h)[[a in rare or b in rare for a, b in zip(h[:-1].tolist(), h[1:].tolist(), strict=True)]]]]))
        bits = 20
        self.mask, self.some = U64((1 << bits) - 1), np.zeros(1 << bits, bool)
        self.some[self.seeds & self.mask] = True
        rows, label = [], []
        for k, f in enumerate(self.families):
            for h in templates[f]:
                for v in range(VARIANTS):
                    rows.append(self._variant(h, others, rng, v))
                    label.append(k)
        rows += others
        label += [len(self.families)] * len(others)
        self._fit([self.vector(h) for h in rows], np.array(label), rng)

    @staticmethod
    def _variant(h: np.ndarray, others: list[np.ndarray], rng: np.random.Generator, v: int) -> np.ndarray:
        if v == 0:
            return h
        if v % 3 == 1 and len(h) > 5:  # a word or two are lost
            h = np.delete(h, rng.choice(len(h), 1 + int(rng.random() < 0.5), replace=False))
        elif v % 3 == 2 and len(h) > 12:  # a part of the line
            a = int(rng.integers(0, len(h) // 3))
            h = h[a : a + max(8, 2 * len(h) // 3)]
        if rng.random() < 0.4 and others:  # other words around it
            o = others[int(rng.integers(len(others)))][:12]
            h = np.concatenate([o, h]) if rng.random() < 0.5 else np.concatenate([h, o])
        return h

    def vector(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns and values of a paragraph's features at unit length; the last column is the share of other words."""
        both = np.unique(np.concatenate([h, _pairs(h)]))
        k = np.minimum(np.searchsorted(self.features, both), len(self.features) - 1)
        k = k[self.features[k] == both]
        inside = np.isin(h, self.words).mean() if len(h) else 0.0
        x = np.full(len(k) + 1, 1.0)
        x[:-1] /= np.sqrt(max(1, len(k)))
        x[-1] = 1.0 - inside
        return np.append(k, len(self.features)), x

    def logits(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        columns, values = np.concatenate([v[0] for v in vectors]), np.concatenate([v[1] for v in vectors])
        first = np.cumsum([0] + [len(v[0]) for v in vectors[:-1]])
        return np.add.reduceat(self.weights[columns] * values[:, None], first, axis=0) + self.bias

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def _fit(self, vectors: list, label: np.ndarray, rng: np.random.Generator) -> None:
        n, classes = len(label), len(self.families) + 1
        held = rng.random(n) < 0.25
        learn, check = np.flatnonzero(~held), np.flatnonzero(held)
        self.weights, self.bias = np.zeros((len(self.features) + 1, classes)), np.zeros(classes)
        own = [vectors[i] for i in learn]
        columns, values = np.concatenate([v[0] for v in own]), np.concatenate([v[1] for v in own])
        row = np.repeat(np.arange(len(own)), [len(v[0]) for v in own])
        by = np.argsort(columns, kind="stable")
        edge = np.flatnonzero(np.diff(columns[by], prepend=-1))
        weight = 1.0 / np.bincount(label[learn], minlength=classes)[label[learn]]  # every class counts the same
        weight /= weight.sum()
        speed = np.zeros_like(self.weights)
        for _ in range(STEPS):
            p = self._softmax(self.logits(own))
            p[np.arange(len(own)), label[learn]] -= 1
            p *= weight[:, None]
            g = PENALTY * self.weights
            g[columns[by][edge]] += np.add.reduceat(p[row[by]] * values[by][:, None], edge, axis=0)
            speed = 0.9 * speed - RATE * g
            self.weights += speed
            self.bias -= RATE * p.sum(axis=0)
        z = self.logits([vectors[i] for i in check])
        truth = label[check]
        loss = {t: -np.log(self._softmax(z / t)[np.arange(len(check)), truth] + 1e-12).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
        self.temperature = min(loss, key=loss.get)
        family = self._softmax(z / self.temperature)[:, :-1].max(axis=1)
        foreign = family[truth == classes - 1]
        self.least = max(0.5, float(np.quantile(foreign, 0.999)) if len(foreign) else 0.5)

    def similarity(self, h: np.ndarray, family: str) -> float:
        """How well a template of the family confirms the paragraph: the better of the two shares, the second only by its rule."""
        own, best = np.unique(_pairs(h)), 0.0
        for t in self.pairs[family]:
            both = len(np.intersect1d(own, t, assume_unique=True))
            share = both / max(1, len(t))
            if both >= LEAST_PAIRS and both >= CONTAINED * len(own):
                share = max(share, both / len(own))
            best = max(best, share)
        return best

    def scan(self, h: np.ndarray) -> tuple[str, float, float] | None:
        """Family, probability, similarity; None where the classifier says unknown or no template confirms."""
        p = self._softmax(self.logits([self.vector(h)]) / self.temperature)[0]
        k = int(p[:-1].argmax())
        if p[k] < self.least:
            return None
        near = {f: self.similarity(h, f) for f in self.families}
        s = near[self.families[k]]
        # a template of another family that fits better, or as well, speaks against the prediction
        if s < COVERED or any(o >= s for f, o in near.items() if f != self.families[k]):
            return None
        return self.families[k], float(p[k]), s


def sampled_paragraphs(docs: DataFrame, text: str = "text", size: int = SAMPLE) -> list[str]:
    """About `size` paragraphs (bounded twice: by share, then at 4 x size), one at a hashed place of each text drawn."""
    n = docs.count()
    share = min(1.0, size / max(1, n))
    drawn = docs.where(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.split(F.col(text), "\n").alias("p"))
    one = drawn.select(F.get("p", F.pmod(F.hash("p"), F.size("p"))).alias("p"))
    return [r["p"] for r in one.where(F.length("p") > 0).orderBy(F.xxhash64("p")).limit(4 * size).collect()]


def scan(docs: DataFrame, scanner: Scanner, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, paragraph (place of the line, from 0), family, probability, similarity for each paragraph that declares a license.

    Null and empty texts declare none; a null id is reported as null; repeated rows are each reported. Other columns are not
    carried.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, _, t in pieces(batch, "text"):
                w = Words(t, spaces=_SPLIT)
                if len(w.hash) < 2:
                    continue
                pair = _pairs(w.hash)
                at = np.flatnonzero(scanner.some[pair & scanner.mask])
                k = np.minimum(np.searchsorted(scanner.seeds, pair[at]), len(scanner.seeds) - 1)
                at = at[scanner.seeds[k] == pair[at]]
                lines = np.flatnonzero(t.data == 10)
                # a line's number over all texts here: line feeds before it and texts begun
                line = np.searchsorted(lines, w.starts[at]) + (doc := np.searchsorted(w.first, at, "right") - 1)
                edges = np.flatnonzero(np.diff(line, prepend=-1, append=-2)) if len(at) else np.zeros(1, np.int64)
                for p, q in zip(edges[:-1], edges[1:], strict=True):
                    if q - p < LEAST_SEEDS:
                        continue
                    d, n = int(doc[p]), int(np.searchsorted(lines, w.starts[at[p]]))
                    low = max(int(t.offsets[d]), int(lines[n - 1]) + 1 if n else 0)
                    high = min(int(t.offsets[d + 1]), int(lines[n]) if n < len(lines) else len(t.data))
                    words = w.hash[np.searchsorted(w.starts, low) : np.searchsorted(w.starts, high)]
                    if found := scanner.scan(words):
                        number = n - int(np.searchsorted(lines, t.offsets[d]))
                        out.append((batch.column(0)[a + d].as_py(), number, *found))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(cols, kinds, strict=True)], names=["doc_id", "paragraph", "family", "probability", "similarity"])

    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return texts.mapInArrow(find, "doc_id long, paragraph long, family string, probability double, similarity double")


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return scan(docs, Scanner(sampled_paragraphs(docs, text)), key, text)
