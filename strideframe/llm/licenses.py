"""Operator 10: license scans by a trained paragraph classifier.

A paragraph is a line, or a block of lines between blank ones. A logistic regression
over hashed single words and word pairs gives each paragraph a probability for each
license family and for none of them. It is trained here, on notices and whole texts of
licenses in many varied forms, whole and wrapped, and on a bounded sample of the
corpus's own paragraphs, and its probabilities are calibrated by a temperature on
examples that were held out. A paragraph whose likeliest class has less than
LEAST_PROBABILITY is unknown. A prediction is confirmed if the paragraph shares at least
LEAST_OVERLAP of the word pairs of one of the family's templates, or of its own; the
comparison has no part in training. A block is reported where none of its lines is.

The bounded sample: SAMPLE_DOCS documents, the first by a hash of their key, and
SAMPLE_LINES of their paragraphs. Those without any of the words CUES are examples of no
license, those with one stay out. The bounds hold for training only: every paragraph of
every document is classified, whole.

Defined cases: a null text is an empty one; a text without licensed paragraphs has no
family; of several the confirmed ones come first, then the likeliest, then the first;
very long texts are scanned whole, paragraph by paragraph; repeated rows are scanned each;
of sampled rows that share a key the least text is learnt from; an empty table gives an
empty result; kept columns named as results give way to them, all others may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, chunks
from .words import WordTable, mix

#: Texts and notices of public licenses.
MIT_TEXT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
ISC_TEXT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
BSD_TEXT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
APACHE_TEXT = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
)
UNLICENSE_TEXT = (
    "This is free and unencumbered software released into the public domain. "
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
TEMPLATES: dict[str, list[str]] = {
    "AGPL": ["This program is licensed under the GNU Affero General Public License, version 3.", "You should have received a copy of the GNU Affero General Public License along with this program."],
    "Apache": [APACHE_TEXT, "Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "SPDX-License-Identifier: Apache-2.0"],
    "BSD": [BSD_TEXT, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: GPL-3.0-only"],
    "ISC": [ISC_TEXT, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Licensed under the ISC License."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "You should have received a copy of the GNU Lesser General Public License along with this library."],
    "MIT": [MIT_TEXT, "Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "Unlicense": [UNLICENSE_TEXT, "This is free and unencumbered software released into the public domain.", "Released into the public domain under the Unlicense."],
}
#: Names of the families' licenses, and sentences that declare one by name; they are learnt from, not compared with.
NAMES = {
    "AGPL": ["GNU Affero General Public License", "AGPL version 3"], "Apache": ["Apache License 2.0", "Apache License, Version 2.0"], "BSD": ["BSD License", "BSD 2-Clause License"], "CC-BY": ["Creative Commons Attribution License", "CC BY 4.0"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial License", "CC BY-NC 4.0"], "CC-BY-SA": ["Creative Commons Attribution-ShareAlike License", "CC BY-SA 4.0"], "CC0": ["CC0 1.0 Universal", "Creative Commons Zero"],
    "GPL": ["GNU General Public License", "GNU GPL v3"], "ISC": ["ISC License"], "LGPL": ["GNU Lesser General Public License", "GNU LGPL"], "MIT": ["MIT License", "MIT license"], "MPL": ["Mozilla Public License, version 2.0", "MPL 2.0"], "Unlicense": ["Unlicense"],
}
CARRIERS = ["Licensed under the {}.", "This work is licensed under {}.", "Released under the {}", "Distributed under the terms of the {}.", "{}", "Use of this file is governed by the {}."]
#: Lines that use the same words and declare nothing.
DECOYS = [
    "The new version of the software was released under great pressure in May.",
    "She is a licensed nurse and works with the general public.",
    "All rights reserved.",
    "A copy of the letter was distributed to the members free of charge.",
    "You must have a driving license to rent a car here.",
    "The terms of the agreement were modified by both sides.",
    "This work was done under the old law, version 2 of the text.",
    "You need the written permission of the owner to enter the garden.",
    "The warranty covers the engine for two years.",
    "The domain of the function is the real line.",
    "The foundation will publish its source for the following conditions.",
]
#: Words by which a paragraph may speak of a license.
CUES = frozenset("license licence licensed licensing copyright copyrighted permission redistribution redistribute spdx gnu mit apache bsd mozilla unlicense warranty domain".split())
FAMILIES = ["", *sorted(TEMPLATES)]

BITS = 16
SAMPLE_DOCS = 400
SAMPLE_LINES = 3000
VARIANTS = 120
LEAST_PROBABILITY = 0.5
LEAST_OVERLAP = 0.6
CHUNK = 1_000_000

SPAN = T.StructType([
    T.StructField("family", T.StringType()),
    T.StructField("first_byte", T.IntegerType()),
    T.StructField("end_byte", T.IntegerType()),
    T.StructField("probability", T.DoubleType()),
    T.StructField("confirmed", T.BooleanType()),
])
SPAN_ARROW = pa.list_(pa.struct([("family", pa.string()), ("first_byte", pa.int32()), ("end_byte", pa.int32()), ("probability", pa.float64()), ("confirmed", pa.bool_())]))


def plain_words(line: str) -> list[str]:
    return re.findall(r"[^\W_]+", line.lower())


def pairs(words: Sequence[str]) -> set[tuple[str, str]]:
    return set(zip(["", *words], [*words, ""]))


_TEMPLATE_PAIRS = {k: [pairs(plain_words(t)) for t in v] for k, v in TEMPLATES.items()}


def overlap(line: str, family: str) -> float:
    """The largest share, over the family's templates, of word pairs that the line has of the template, or the template of the line."""
    own = pairs(plain_words(line))
    return max(len(own & t) / min(len(own), len(t)) for t in _TEMPLATE_PAIRS[family])


def features(texts: Sequence[str]) -> tuple[WordTable, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words in lower case, each word's line, and the buckets of the word and of its pair with the next one of the line."""
    words = WordTable(texts, lower=True)
    lines = np.cumsum(words.bytes == 10)[words.starts] if len(words.starts) else np.zeros(0, np.int64)
    h = words.hashes
    after = np.append(h[1:], np.uint64(0))
    after[np.append(lines[1:] != lines[:-1], True)[: len(h)]] = 0
    shift = np.uint64(64 - BITS)
    return words, lines, (h >> shift).astype(np.intp), (mix(h * np.uint64(3) + after) >> shift).astype(np.intp)


class Classifier:
    """Class weights by bucket; a paragraph's logits are the sum over its features divided by the root of their number."""

    def __init__(self) -> None:
        self.weights = np.zeros((1 << BITS, len(FAMILIES)), np.float32)
        self.bias = np.zeros(len(FAMILIES), np.float32)
        self.temperature = 1.0

    def sums(self, one: np.ndarray, two: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The weights of all features from each place on to the next."""
        return np.add.reduceat(self.weights[one] + self.weights[two], at, axis=0)

    def logits(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return sums / np.sqrt(2 * counts)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, lines: Sequence[str], classes: np.ndarray, rng: np.random.Generator, epochs: int = 12) -> None:
        """AdaGrad over batches; every fifth example only sets the temperature."""
        words, of, one, two = features(lines)
        some = np.flatnonzero(np.diff(words.first))
        at, counts, y = words.first[some], np.diff(words.first)[some], classes[some]
        held = np.arange(len(some)) % 5 == 4
        train, squares = np.flatnonzero(~held), np.full(self.weights.shape, 1e-6, np.float32)
        for _ in range(epochs):
            order = rng.permutation(train)
            for i in range(0, len(order), 64):
                rows = order[i : i + 64]
                n = counts[rows]
                member = np.repeat(np.arange(len(rows)), n)
                word = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[rows], n)
                starts = np.cumsum(n) - n
                p = self.probabilities(self.logits(self.sums(one[word], two[word], starts), n))
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= np.sqrt(2 * n)[:, None]
                self.bias -= 0.05 * p.mean(0)
                buckets, where = np.unique(np.concatenate((one[word], two[word])), return_inverse=True)
                step = np.zeros((len(buckets), p.shape[1]), np.float32)
                np.add.at(step, where, p[np.concatenate((member, member))])
                step += 1e-4 * self.weights[buckets]
                squares[buckets] += step**2
                self.weights[buckets] -= 0.3 * step / np.sqrt(squares[buckets])
        rows = np.flatnonzero(held)
        all_logits = self.logits(self.sums(one, two, at), counts)[rows] if len(some) else np.zeros((0, len(FAMILIES)))
        grid = np.geomspace(0.2, 5, 40)
        losses = []
        for self.temperature in grid:
            p = self.probabilities(all_logits)
            losses.append(-np.log(np.maximum(p[np.arange(len(rows)), y[rows]], 1e-9)).mean())
        self.temperature = float(grid[int(np.argmin(losses))])


def paragraphs(text: str) -> list[str]:
    """The lines of a text, and its blocks of more than one line."""
    lines = [x for x in text.split("\n") if x.strip()]
    return lines + [b for b in re.split(r"\n\s*\n", text) if "\n" in b.strip()]


def training_lines(corpus: Sequence[str], rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """Templates in many forms, decoys, templates' words out of order, and paragraphs of the corpus that don't speak of licenses."""
    lines, classes = [], []
    filler = [w for t in corpus[:50] for w in t.split()[:40]] or ["the", "file", "and", "project"]

    def add(line: str, k: int) -> None:
        lines.append(line)
        classes.append(k)

    for k, family in enumerate(FAMILIES[1:], 1):
        for template in TEMPLATES[family]:
            words = template.split()
            for v in range(VARIANTS):
                w = list(words)
                if v % 3 == 1 and len(w) > 5:
                    w = [x for x in w if rng.random() > 0.08]
                if v % 4 == 2:
                    w = [*rng.choice(filler, int(rng.integers(1, 8))), *w]
                if v % 4 == 3:
                    w = [*w, *rng.choice(filler, int(rng.integers(1, 8)))]
                if len(words) > 30 and v % 2:  # a whole text's lines
                    i = int(rng.integers(0, len(w) - 15))
                    w = w[i : i + int(rng.integers(15, len(w) - i + 1))]
                line = " ".join(w)
                add((line, line.upper(), line.rstrip(".:"), line)[v % 4] if v % 5 else line, k)
            for _ in range(VARIANTS // 10):
                add(" ".join(rng.permutation(words)[: max(2, min(len(words) // 3, 12))]), 0)
        for name in NAMES[family]:
            for carrier in CARRIERS * (VARIANTS // 20):
                add(" ".join([*rng.choice(filler, int(rng.integers(0, 6))), carrier.format(name)]), k)
    for cue in sorted(CUES) * (VARIANTS // 10):  # a word alone declares nothing
        w = list(rng.choice(filler, int(rng.integers(4, 14))))
        w.insert(int(rng.integers(0, len(w))), cue)
        add(" ".join(w), 0)
    for line in DECOYS * (VARIANTS // 4):
        add(" ".join([*rng.choice(filler, int(rng.integers(0, 4))), line]), 0)
    own = [x for t in corpus for x in paragraphs(t) if not CUES.intersection(plain_words(x))]
    for i in rng.permutation(len(own))[:SAMPLE_LINES]:
        add(own[i], 0)
    return [x.replace("\n", " ") for x in lines], np.array(classes)


def train(corpus: Sequence[str], seed: int = 3) -> Classifier:
    rng = np.random.default_rng(seed)
    model = Classifier()
    model.fit(*training_lines(corpus, rng), rng)
    return model


def scan_texts(model: Classifier, texts: Sequence[str]) -> list[list[tuple]]:
    """The licensed paragraphs of each text, as tuples of ``SPAN``."""
    out: list[list[tuple]] = [[] for _ in texts]
    words, lines, one, two = features(texts)
    if not len(lines):
        return out
    at = np.flatnonzero(np.diff(lines, prepend=-1))
    counts = np.diff(np.append(at, len(lines)))
    sums = model.sums(one, two, at)
    # A block goes on where the next line of the same text has a word as well.
    here = lines[at]
    own = np.searchsorted(words.text_ends, words.starts[at])
    new = np.append(True, (here[1:] != here[:-1] + 1) | (own[1:] != own[:-1]))
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(at)))
    reported = np.zeros(len(at), bool)

    def report(at: np.ndarray, counts: np.ndarray, sums: np.ndarray, texts_: np.ndarray, skip: np.ndarray) -> np.ndarray:
        p = model.probabilities(model.logits(sums, counts))
        best = p.argmax(1)
        found = (best > 0) & (p[np.arange(len(p)), best] >= LEAST_PROBABILITY) & ~skip
        for i in np.flatnonzero(found).tolist():
            a, b, text = int(words.starts[at[i]]), int(words.ends[at[i] + counts[i] - 1]), int(texts_[i])
            family, start = FAMILIES[best[i]], int(begins[text])
            confirmed = overlap(words.data[a:b].decode(), family) >= LEAST_OVERLAP
            out[text].append((family, a - start, b - start, float(p[i, best[i]]), confirmed))
        return found

    begins = np.concatenate(([0], words.text_ends + 1))
    reported = report(at, counts, sums, own, reported)
    some = np.flatnonzero(sizes > 1)
    if len(some):
        held = np.logical_or.reduceat(reported, first)
        report(at[first][some], np.add.reduceat(counts, first)[some], np.add.reduceat(sums, first, axis=0)[some], own[first][some], held[some])
    return out


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with license_family, license_status (confirmed, unconfirmed or none), license_probability, and license_spans (``SPAN``, of bytes)."""
    # Keys are chosen first, so that tasks send the driver no more texts than the sample has.
    texts = df.select(F.col(key).alias("k"), F.col(text).alias("text")).where("k is not null and text is not null")
    chosen = texts.select("k").distinct().orderBy(F.xxhash64("k", F.lit(10)), "k").limit(SAMPLE_DOCS)
    sample = texts.join(F.broadcast(chosen), "k").groupBy("k").agg(F.min("text")).collect()
    model = train([t for _, t in sorted((repr(k), t) for k, t in sample)])

    def make():
        def run(column: pa.Array) -> list[pa.Array]:
            texts, spans = [t or "" for t in column.to_pylist()], []
            for a, b in chunks([len(t) for t in texts], CHUNK):
                spans += scan_texts(model, texts[a:b])
            tops = [min(s, key=lambda x: (not x[4], -x[3], x[1])) if s else None for s in spans]
            names = ("family", "first_byte", "end_byte", "probability", "confirmed")
            return [
                pa.array([t and t[0] for t in tops], pa.string()),
                pa.array(["none" if t is None else "confirmed" if t[4] else "unconfirmed" for t in tops]),
                pa.array([t and t[3] for t in tops], pa.float64()),
                pa.array([[dict(zip(names, x)) for x in s] for s in spans], SPAN_ARROW),
            ]

        return run

    fields = [
        T.StructField("license_family", T.StringType()),
        T.StructField("license_status", T.StringType(), False),
        T.StructField("license_probability", T.DoubleType()),
        T.StructField("license_spans", T.ArrayType(SPAN)),
    ]
    return append_arrow(df, [text], fields, make, keep)
