"""Licence scan: a paragraph classifier over sparse word n-grams, with templates confirming it.

A paragraph is a run of lines that have words; a line without a word ends it, so notices wrapped over
lines or set in comment marks stay whole. A paragraph is read in windows of 40 words that overlap by half. A
softmax regression over counts of the words and word pairs of the templates gives each window a licence
family or the unknown class. It is trained here, on the templates, fragments and pairs of them set among
other words, and on windows of a bounded sample of documents as the unknown class. The unknown class
is calibrated: each family is weighed against it alone, and believed only above the highest value that
held-back unknown windows reach; two licences in one window do not take belief from each other.

Believed windows, with a window around them, are compared with the templates of every believed family.
A template counts when half of its word triples (or of a window's, where that is less) stand close
together; a short one must stand there whole, and a template that states a number needs that number.
Of templates that fit the same words, the one with most agreeing triples wins. After
``SPDX-License-Identifier:`` the whole expression is read, with AND, OR and WITH.

Words that no template has carry no weight, so a window without a template word is unknown at once, and
windows are scored from sums over half windows in whole arrays.

Edge cases: null, empty and word-less texts have no windows and no licence. An empty document table, or
one without other windows, trains on templates alone. Repeated rows are scanned alike. An input
column named like an output column is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from headway.llm.common import annotate, col, thinned
from headway.llm.decontam import words_of

HALF = 20
UNKNOWN = 0
#: Share of word triples that must agree; a template of SHORT triples or fewer must stand there whole.
CONFIRM, SHORT = 0.5, 6
SPDX, JOINS = [b"spdx", b"license", b"identifier"], (b"and", b"or")
#: Pairs of templates learned from.
PAIRS = 300
#: Most words of a licence or an exception that is not one of ours, in an expression.
OTHER_ID = 6

# What public licences and the notices that grant them say.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        "Released under the GPLv3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License v2.0.",
        "Released under the GPLv2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is released under the LGPLv3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPLv3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Released under the New BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-ND-4.0": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ),
    "CC0-1.0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "ISC": (
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Unlicense": (
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ),
}
#: Talk about licences that grants nothing.
NEAR_MISSES = (
    "The driver renewed her license last week.", "You need a licence to fish in this river.",
    "Permission to enter the building was granted.", "All rights reserved.", "Copyright by the author.",
    "The general public was invited to the meeting.", "Version 2 of the plan was published in public.",
    "He studied at MIT for 4 years.", "The apache helicopter landed at 2.", "The work is released under pressure.",
    "This work is published in the public interest.", "The copy of this file is on the table with the terms.",
    "A foundation gave free software to the school.", "See the terms and conditions of the contract.",
)
FAMILIES = (None, *TEMPLATES)


class Model:
    """Vocabulary, pair table, weights (features x classes), bias and the calibrated threshold."""

    def __init__(self):
        phrases = [words_of(t) for ts in TEMPLATES.values() for t in ts]
        words = sorted({w for p in phrases for w in p})
        self.vocab = {w: i for i, w in enumerate(words)}
        self.n_words = len(words)
        pairs = {self.vocab[a] * self.n_words + self.vocab[b] for p in phrases for a, b in zip(p, p[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.width = self.n_words + len(self.pairs)
        self.weights = np.zeros((self.width, len(FAMILIES)))
        self.bias = np.zeros(len(FAMILIES))
        self.threshold = 0.5
        #: (family, triples, words, triples with a number) of each template, and where each triple stands in them.
        self.templates: list[tuple[int, int, int, set[int]]] = []
        self.where: dict[tuple, list[tuple[int, int]]] = {}
        for family, texts in enumerate(TEMPLATES.values(), 1):
            for words in map(words_of, texts):
                if words[:3] == SPDX:  # read by expression
                    continue
                shape = list(dict.fromkeys(_triples(words)))
                for number, triple in enumerate(shape):
                    self.where.setdefault(triple, []).append((len(self.templates), number))
                numbers = {i for i, t in enumerate(shape) if any(w.isdigit() for w in t)}
                self.templates.append((family, len(shape), len(words), numbers))

    def features(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, feature) of the known words and pairs of a row of word numbers (-1: unknown)."""
        one = np.flatnonzero(ids >= 0)
        two = one[:-1][np.diff(one) == 1] if len(one) else one
        key = ids[two] * self.n_words + ids[two + 1]
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = self.pairs[at] == key
        return np.concatenate([one, two[hit]]), np.concatenate([ids[one], self.n_words + at[hit]])

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocab.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def rows(self, samples: list[list[bytes]]) -> np.ndarray:
        x = np.zeros((len(samples), self.width), np.float32)
        for i, words in enumerate(samples):
            np.add.at(x[i], self.features(self.ids(words))[1], 1)
        return x

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, samples: list[list[bytes]], labels: list[int], rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> None:
        """Softmax regression by full gradient steps with momentum, every class weighing the same."""
        x, y = self.rows(samples), np.array(labels)
        goal = np.eye(len(FAMILIES), dtype=np.float32)[y]
        weight = (1 / np.maximum(goal.sum(axis=0), 1))[y][:, None] / max(1, len(set(labels)))
        w, b = self.weights, self.bias
        step_w, step_b = np.zeros_like(w), np.zeros_like(b)
        for _ in range(rounds):
            g = (self.probabilities(x @ w + b) - goal) * weight
            step_w = 0.9 * step_w - rate * (x.T @ g + decay * w)
            step_b = 0.9 * step_b - rate * g.sum(axis=0)
            w, b = w + step_w, b + step_b
        self.weights, self.bias = w, b

    def calibrate(self, unknown: list[list[bytes]]) -> None:
        """The threshold: the highest belief that held-back unknown windows reach, between 0.5 and 0.95."""
        if unknown:
            top = _belief(self.rows(unknown) @ self.weights + self.bias).max()
            self.threshold = float(np.clip(top * 1.01, 0.5, 0.95))

    def overlaps(self, words: list[bytes]) -> int:
        """The most triples of one template that the words have."""
        found: dict[int, set] = {}
        for triple in _triples(words):
            for template, number in self.where.get(triple, ()):
                found.setdefault(template, set()).add(number)
        return max(map(len, found.values()), default=3 if _spdx(words) else 0)

    def confirmed(self, words: list[bytes], families) -> list[tuple[int, int, int]]:
        """(family, from, to) of the templates of these families that stand in the words, and of SPDX expressions."""
        triples = _triples(words)
        hits: dict[int, list[tuple[int, int]]] = {}
        for i, triple in enumerate(triples):
            for template, number in self.where.get(triple, ()):
                hits.setdefault(template, []).append((i, number))
        room = min(2 * HALF - 2, len(triples)) if len(triples) > SHORT else 2 * HALF - 2
        fits = []
        for template, at in hits.items():
            family, size, length, numbers = self.templates[template]
            if family not in families:
                continue
            short = size <= SHORT
            count, lo, hi = _densest(at, size - 1 if short else length + length // 4)
            if count < (size if short else CONFIRM * min(size, room)):
                continue
            if numbers and not any(n in numbers for _, n in at[lo:hi]):
                continue
            fits.append((-count, -count / size, template, family, {i for i, _ in at[lo:hi]}))
        kept: list[tuple[int, set]] = []
        for *_, family, at in sorted(fits, key=lambda x: x[:3]):
            if all(f == family or 2 * len(at & other) < len(at) for f, other in kept):
                kept.append((family, at))
        return [(family, min(at), max(at) + 3) for family, at in kept] + _spdx(words)

    def scan(self, texts: list) -> list[tuple[int, list[int], float, int]]:
        """Per text: windows, confirmed families, the highest belief in one of them, windows believed but not confirmed."""
        lines = [[words_of(x) for x in (t or "").split("\n")] for t in texts]
        words = [w for ls in lines for l in ls for w in l]
        sizes = np.array([len(l) for ls in lines for l in ls], np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(ls) for ls in lines])
        if not len(words):
            return [(0, [], 0.0, 0)] * len(texts)
        full = sizes > 0
        opens = full & np.concatenate([[True], ~full[:-1] | (owner[1:] != owner[:-1])])
        sizes = np.bincount((np.cumsum(opens) - 1)[full], sizes[full]).astype(np.int64)
        owner = owner[opens]
        # Half windows: runs of HALF words inside a paragraph, numbered through; a window is two neighbours.
        halves = -(-sizes // HALF)
        first_half = np.cumsum(halves) - halves
        para = np.repeat(np.arange(len(sizes)), sizes)
        begin = np.cumsum(sizes) - sizes
        half = first_half[para] + (np.arange(len(words)) - begin[para]) // HALF
        pos, feature = self.features(self.ids(words))
        pair = feature >= self.n_words
        inside = ~pair | (para[np.minimum(pos + 1, len(words) - 1)] == para[pos])
        pos, feature = pos[inside], feature[inside]
        order = np.argsort(half[pos], kind="stable")
        pos, feature = pos[order], feature[order]
        n_half = int(halves.sum())
        sums = np.zeros((n_half + 1, len(FAMILIES)))
        if len(pos):
            at = half[pos]
            cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            sums[at[cut]] = np.add.reduceat(self.weights[feature], cut, axis=0)
        half_para = np.repeat(np.arange(len(sizes)), halves)
        last = np.append(half_para[1:] != half_para[:-1], True)
        window = ~last | np.concatenate([[True], last[:-1]])
        belief = _belief(sums[:-1] + np.where(last[:, None], 0, sums[1:]) + self.bias)
        out = [[int(n), set(), 0.0, 0] for n in np.bincount(owner[half_para], window, len(texts))]
        ends = begin + sizes
        regions: list[list] = []  # [paragraph, from, to, windows]
        for h in np.flatnonzero(window & (belief.max(axis=1) >= self.threshold)).tolist():
            p = int(half_para[h])
            start = int(begin[p]) + (h - int(first_half[p])) * HALF
            lo, hi = max(int(begin[p]), start - 2 * HALF), min(start + 4 * HALF, int(ends[p]))
            if regions and regions[-1][0] == p and lo <= regions[-1][2]:
                regions[-1][2] = hi
            else:
                regions.append([p, lo, hi, []])
            regions[-1][3].append((h, start))
        for p, lo, hi, members in regions:
            top = belief[[h for h, _ in members]].max(axis=0)
            found = self.confirmed(words[lo:hi], set((np.flatnonzero(top >= self.threshold) + 1).tolist()))
            row = out[owner[p]]
            for family, _, _ in found:
                row[1].add(family)
                row[2] = max(row[2], float(top[family - 1]))
            spans = [(lo + a, lo + b) for _, a, b in found]
            row[3] += sum(all(b <= start or a >= start + 2 * HALF for a, b in spans) for _, start in members)
        return [(n, sorted(found), best, open_) for n, found, best, open_ in out]


def _belief(scores: np.ndarray) -> np.ndarray:
    """Of each family, its probability when there is only it and the unknown class."""
    return 1 / (1 + np.exp(np.clip(scores[:, :1] - scores[:, 1:], -500, 500)))


def _densest(at: list[tuple[int, int]], reach: int) -> tuple[int, int, int]:
    """The most different numbers among (position, number) pairs whose positions are at most ``reach`` apart, and where."""
    inside: dict[int, int] = {}
    best, lo = (0, 0, 0), 0
    for hi, (i, number) in enumerate(at):
        inside[number] = inside.get(number, 0) + 1
        while i - at[lo][0] > reach:
            old = at[lo][1]
            inside[old] -= 1
            if not inside[old]:
                del inside[old]
            lo += 1
        if len(inside) > best[0]:
            best = len(inside), lo, hi + 1
    return best


def _spdx(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(family, from, to) of every known licence in the SPDX expressions of a row of words."""
    found = []
    for start in [i for i, w in enumerate(words) if w == SPDX[0] and words[i : i + 3] == SPDX]:
        i = start + 3
        while True:
            known = ((n, IDS[x]) for n in range(OTHER_ID, 0, -1) if (x := tuple(words[i : i + n])) in IDS and len(x) == n)
            n, family = next(known, (0, UNKNOWN))
            i += n
            if family != UNKNOWN:
                found.append((family, start, i))
            if family == UNKNOWN or words[i : i + 1] == [b"with"]:  # another licence or an exception: on to what joins it
                i = next((j for j in range(i, min(i + OTHER_ID + 1, len(words))) if words[j] in JOINS), len(words))
            if i >= len(words) or words[i] not in JOINS:
                break
            i += 1
    return found


def _triples(words: list[bytes]) -> list[tuple]:
    return list(zip(words, words[1:], words[2:]))


#: What SPDX identifiers look like as words, with and without what says if later versions count.
IDS = {
    (*words_of(name), *words_of(tail)): family
    for family, name in enumerate(TEMPLATES, 1)
    for tail in ("", "only", "or later")
} | {(b"mit", b"0"): UNKNOWN}


def training_windows(seed: int, others: list[list[bytes]]) -> tuple[list, list]:
    """Templates and fragments of them set among other words, and pairs of them."""
    rng = np.random.default_rng(seed)
    filler = others or [words_of(t) for t in NEAR_MISSES]

    def some(most: int) -> list[bytes]:
        words = filler[rng.integers(len(filler))]
        return words[: int(rng.integers(0, most + 1))]

    samples, labels = [], []
    for label, phrases in enumerate(TEMPLATES.values(), 1):
        for phrase in phrases:
            words = words_of(phrase)
            for i in range(12):
                size = int(rng.integers(HALF // 2, HALF + 1)) if i % 3 == 0 else 2 * HALF
                lo = int(rng.integers(0, max(1, len(words) - size + 1)))
                part = words[lo : lo + size]
                room = 2 * HALF - len(part)
                before = some(room)
                samples.append([*before, *part, *some(max(0, room - len(before)))])
                labels.append(label)
    phrases = [(label, words_of(x)) for label, texts in enumerate(TEMPLATES.values(), 1) for x in texts]
    for _ in range(PAIRS):  # two licences in one window count for both
        two = [phrases[i] for i in rng.integers(len(phrases), size=2)]
        samples += [[*two[0][1][:HALF], *two[1][1][:HALF]]] * 2
        labels += [label for label, _ in two]
    for phrase in NEAR_MISSES:
        for _ in range(12):
            samples.append([*some(12), *words_of(phrase), *some(12)])
            labels.append(UNKNOWN)
    return samples, labels


def train(df: DataFrame, text: str, key: str, documents: int = 400, windows: int = 4000, seed: int = 11) -> Model:
    """Fit on the templates and on at most ``windows`` windows of about ``documents`` sampled documents."""
    model = Model()
    named = df.where(col(text).isNotNull() & col(key).isNotNull())
    width = 2 * HALF
    cut = F.split(F.trim(F.regexp_replace("paragraph", r"\s+", " ")), " ")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / width).cast("int")), lambda i: F.array_join(F.slice("w", i * width + 1, width), " "))
    sample = (
        thinned(named.select(col(key).alias("key"), col(text).alias("text")), "key", documents, max(1, named.count()), 9)
        .select(F.explode(F.split("text", r"\n\s*\n")).alias("paragraph"))
        .select(cut.alias("w"))
        .select(F.explode(pieces).alias("piece")).where("piece <> ''").distinct()
        .orderBy(F.xxhash64("piece")).limit(windows)
    )
    other = [w[:width] for (t,) in sample.collect() if (w := words_of(t))]
    # What resembles a template is not taken for the unknown class.
    other = [w for w in other if model.overlaps(w) < 3]
    held, used = other[::4], [w for i, w in enumerate(other) if i % 4]
    samples, labels = training_windows(seed, used)
    model.fit(samples + used, labels + [UNKNOWN] * len(used))
    model.calibrate(held)
    return model


def scan(df: DataFrame, text: str, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Add ``licenses`` (confirmed families, sorted), ``n_windows``, ``confidence`` and ``n_unconfirmed``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def run(texts):
            n, found, best, open_ = zip(*m.scan(texts)) if texts else ((), (), (), ())
            return {"licenses": [sorted(FAMILIES[f] for f in fs) for fs in found], "n_windows": n, "confidence": best, "n_unconfirmed": open_}

        return run

    return annotate(df, text, "licenses array<string>, n_windows long, confidence double, n_unconfirmed long", make, keep)
