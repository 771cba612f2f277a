"""Licence scans: a trained paragraph classifier, with a calibrated class for unknown text and comparison with templates.

A paragraph here is a run of neighbouring lines that hold vocabulary: words of the templates below that are common words of
no language. So a notice wrapped over lines is one paragraph, and so is a one-line one between lines of prose. Its features
are its distinct vocabulary words, and pairs of them that stand side by side in a line. Multinomial logistic regression over
these, fitted on wrapped, cut and mixed variants of the templates and on other prose, gives a probability to each family and
to "unknown"; a temperature fitted on variants that were held out calibrates it. A prediction counts if LEAST is reached and a
template of the family confirms it: of the smaller one of the two sets of features, the paragraph's and the template's, the
other holds CONFIRM, and two features or more. A line without vocabulary has no features at all, and the fit makes sure that
the bias alone says unknown; so no line is passed over that the classifier could say anything about. The fit is a step on the
driver over built-in notices; its weights are a table of fixed size, and the scan is DataFrame expressions only.

Edge cases: a null or empty text has no notices; repeated rows are scanned each on its own; a paragraph with several notices
gets the family of the highest probability (first by name in ties) and is told by its first line; a document's families are
sorted by name; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GPL_BODY = "is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_WARRANTY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_BSD_BODY = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
# Public notices as authors put them into files, by family.
TEMPLATES = {
    "agpl": ("This work is licensed under the GNU Affero General Public License, version 3.", "Distributed under the terms of the AGPL license.", "This program " + _GPL_BODY.format("Affero General Public License", 3), "This program " + _WARRANTY.format("Affero General Public License"), "SPDX-License-Identifier: AGPL-3.0-or-later", "Released under AGPLv3"),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "This project is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"),
    "boost": ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)", "SPDX-License-Identifier: BSL-1.0"),
    "bsd": ("Released under the BSD License.", _BSD_BODY, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.", "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc0": ("Released under CC0, no rights reserved under any license.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work and dedicated it to the public domain.", "SPDX-License-Identifier: CC0-1.0"),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", "SPDX-License-Identifier: EPL-2.0"),
    "eupl": ("Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL.", "Licensed under the European Union Public Licence.", "SPDX-License-Identifier: EUPL-1.2"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This program " + _GPL_BODY.format("General Public License", 3), "This program " + _WARRANTY.format("General Public License"), "You should have received a copy of the GNU General Public License along with this program.", "you can redistribute it under the GNU GPL v3", "Licensed under the GPL, version 2 or later.", "Released under GPLv3", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License.", "Distributed under the terms of the LGPL license.", "This library " + _GPL_BODY.format("Lesser General Public License", "2.1"), "Distributed under the LGPL", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "mit": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", _AS_IS, "This software is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Licensed under the MPL 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": ("Copyright, all rights reserved. No part of this work may be copied without written permission.", "This software is proprietary and confidential; no license is granted.", "Unauthorized copying of this file, via any medium, is strictly prohibited.", "All rights reserved."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "SPDX-License-Identifier: Unlicense"),
    "zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "SPDX-License-Identifier: Zlib"),
}
#: Prose that uses such words without being a notice.
OTHER = (
    "The city council will renew the license of the restaurant next year.", "He was asked for his driving license and the papers of the car.", "She gave permission to use the hall for the meeting on Sunday.",
    "The museum asks visitors not to take photographs without permission.", "Copyright law has changed many times in the last century.", "A version of the story was printed in the general press.",
    "The public may use the library free of charge in the summer.", "An apache helicopter was seen over the valley.", "Students of the institute published the source of the data.",
    "The terms of the agreement were published by the foundation.", "Commons and lords debated the licence fee.", "Redistribution of land was the aim of the reform.", "Artistic license is what poets call it.",
    "The committee met to discuss the release of the report.", "The software was installed on every machine in the office.", "The warranty of the car ends after three years, whatever its purpose.",
    "Contributors to the fund are named on the wall of the building.", "The union of the workers is a public body under European law.", "He sold copies of the original book at a fair.",
)
FAMILIES = (*sorted(TEMPLATES), "unknown")
#: Words that say nothing about a notice; no features.
STOP = frozenset("a above an and any are as at be been by can changed copy event file for form free from general has have held his however if in included into is it its law law's left list made may means met must name names not of on one only or other out part permitted person project public see shall should software subject such than that the their this to under use used using version was which will with without work you your program data source international available following 0 1 2 3 4".split())
CONFIRM, LEAST = 0.6, 0.5


def _words(text: str) -> list[str]:
    return [w for w in re.sub(r"[^a-z0-9]+", " ", text.lower()).split(" ") if w]


#: Words of templates of which pairs are features, and those that are features by themselves: not the ones that are common
#: words of some language.
VOCABULARY = frozenset(w for ts in TEMPLATES.values() for t in ts for w in _words(t)) - STOP
SINGLE = VOCABULARY - {"all", "mit", "no"}


def grams(text: str) -> set[str]:
    """The features of a text of one line."""
    w = _words(text)
    return {*(x for x in w if x in SINGLE), *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if a in VOCABULARY and b in VOCABULARY)}


def _variants(rng: np.random.Generator, n: int) -> list[tuple[set[str], int]]:
    """Features of notices wrapped over lines, with words dropped, put in or cut off at the ends, and of scrambled or mixed
    ones that are none; with their classes."""
    out = []
    filler = _words(" ".join(OTHER))

    def wrapped(w: list[str]) -> set[str]:
        step = int(rng.integers(6, 16)) if rng.random() < 0.5 else len(w) + 1
        return set().union(*(grams(" ".join(w[i : i + step])) for i in range(0, max(1, len(w)), step)))

    none = len(FAMILIES) - 1
    for y, family in enumerate(FAMILIES[:-1]):
        for t in TEMPLATES[family]:
            w = _words(t)
            for _ in range(n):
                lo, hi = int(rng.integers(0, 1 + len(w) // 5)), len(w)
                if rng.random() < 0.5 and len(w) > 12:  # a stretch of a long notice, as a page's first lines
                    hi = int(rng.integers(max(lo + 10, len(w) // 3), len(w) + 1))
                part = [x for x in w[lo:hi] if rng.random() > 0.05]
                for _ in range(int(rng.integers(0, 4))):
                    part.insert(int(rng.choice([0, len(part)])), str(rng.choice(filler)))
                out.append((wrapped(part), y))
            for _ in range(n // 4):
                out.append((wrapped([str(x) for x in rng.permutation(w)[: 1 + len(w) // 8]]), none))
    for t in OTHER:
        w = _words(t)
        out += [(wrapped([x for x in w if rng.random() > 0.1]), none) for _ in range(2 * n)]
    # Any one or two words of the vocabulary by themselves are no notice.
    vocabulary = sorted(SINGLE)
    out += [({str(x) for x in rng.choice(vocabulary, int(rng.integers(0, 3)))}, none) for _ in range(len(out) // 4)]
    return out


@lru_cache(maxsize=1)
def fitted(seed: int = 3) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Features, their weights for each family (the temperature within), and biases. Deterministic."""
    rng = np.random.default_rng(seed)
    features = sorted(set().union(*(grams(t) for ts in TEMPLATES.values() for t in ts)))
    index = {g: i for i, g in enumerate(features)}

    def table(rows):
        x, y = np.zeros((len(rows), len(features)), np.float32), np.array([r[1] for r in rows])
        for i, (t, _) in enumerate(rows):
            x[i, [index[g] for g in t if g in index]] = 1
        return x, y

    x, y = table(_variants(rng, 12))
    held, truth = table(_variants(rng, 6))
    k = len(FAMILIES)
    w, b, goal = np.zeros((len(features), k), np.float32), np.zeros(k, np.float32), np.eye(k, dtype=np.float32)[y]
    weight = (len(y) / k / goal.sum(axis=0))[y][:, None].astype(np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(300):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - goal) * weight / len(y)
        vw, vb = 0.9 * vw - (x.T @ g + 1e-4 * w), 0.9 * vb - g.sum(axis=0)
        w, b = w + vw, b + vb
    z = held @ w + b
    loss = lambda t: np.mean(np.log(np.exp(z * t - (z * t).max(axis=1, keepdims=True)).sum(axis=1)) - (z * t)[np.arange(len(z)), truth] + (z * t).max(axis=1))
    t = min((0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0), key=loss)
    if int(b.argmax()) != k - 1:  # a line without features must be unknown, as the scan does not look at it
        raise ValueError("the fit gives text without features to a family")
    return features, w * t, b * t


def _table(spark: SparkSession) -> DataFrame:
    """gram, w (a weight for each family) and in_t (the templates that have it), as a literal of fixed size."""
    features, w, _ = fitted()
    templates = [grams(t) for f in FAMILIES[:-1] for t in TEMPLATES[f]]
    rows = [{"gram": g, "w": [round(float(v), 5) for v in w[i]], "t": [j for j, x in enumerate(templates) if g in x]} for i, g in enumerate(features)]
    schema = "array<struct<gram string, w array<double>, t array<int>>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))


def notices(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and `found`, an array of (line, family, confidence, likeness) of its paragraphs, sorted
    by line; family "unknown" where the classifier or the comparison says so."""
    spark = docs.sparkSession
    features, _, bias = fitted()
    known, pairs = sorted(SINGLE), sorted(g for g in features if " " in g)
    lines = F.split(F.lower(F.coalesce("text", F.lit(""))), "\n", -1)
    hit = lambda x: F.exists(x, lambda w: w.isin(known))  # noqa: E731  a set: its size does not count
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("line"), F.split(x, "[^a-z0-9]+").alias("words")))
    numbered = F.filter(numbered, lambda s: hit(s["words"]))
    # The number is drawn in the scan's own stage, where a repeated task gives the same.
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), numbered.alias("lines"))
    # Of lines with vocabulary, neighbours have the same number after their place among them is taken off.
    rows = rows.select("doc_id", "row", F.posexplode_outer("lines").alias("place", "at")).withColumn("run", F.col("at.line") - F.col("place"))
    words = F.col("at.words")
    single = F.filter(words, lambda w: w.isin(known))
    both = F.transform(F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b")), lambda p: F.concat_ws(" ", p["a"], p["b"]))
    every = F.array_distinct(F.concat(single, F.filter(both, lambda g: g.isin(pairs))))
    rows = rows.select("doc_id", "row", "run", F.col("at.line").alias("line"), F.explode_outer(every).alias("gram"))
    once = rows.groupBy("row", "doc_id", "run", "gram").agg(F.min("line").alias("line"))
    met = once.join(F.broadcast(_table(spark)), "gram", "left")  # of fixed size
    k, sizes = len(FAMILIES), [len(grams(t)) for f in FAMILIES[:-1] for t in TEMPLATES[f]]
    sums = [F.coalesce(F.sum(F.col("w")[j]), F.lit(0.0)).alias(f"w{j}") for j in range(k)]
    shares = [F.count_if(F.array_contains("t", j)).alias(f"t{j}") for j in range(len(sizes))]
    found = met.groupBy("row", "doc_id", "run").agg(F.min("line").alias("line"), F.count("gram").alias("n"), *sums, *shares)
    z = [F.col(f"w{j}") + F.lit(float(bias[j])) for j in range(k)]
    top = F.greatest(*z)
    p = [F.exp(x - top) for x in z]
    total = reduce(Column.__add__, p)
    like = [F.when(F.col(f"t{j}") >= 2, F.col(f"t{j}") / F.least(F.col("n"), F.lit(n))).otherwise(0.0).alias(f"l{j}") for j, n in enumerate(sizes)]
    found = found.select("row", "doc_id", "line", *[(x / total).alias(f"p{j}") for j, x in enumerate(p)], *like)
    at, close = 0, []
    for f in FAMILIES[:-1]:
        n = len(TEMPLATES[f])
        close.append(F.greatest(*[F.col(f"l{j}") for j in range(at, at + n)]))
        at += n
    best = F.greatest(*[F.col(f"p{j}") for j in range(k)])
    family = F.coalesce(*[F.when(F.col(f"p{j}") == best, F.lit(f)) for j, f in enumerate(FAMILIES)])
    likeness = F.coalesce(*[F.when(F.col(f"p{j}") == best, close[j]) for j in range(k - 1)], F.lit(0.0))
    sure = (family != "unknown") & (best >= LEAST) & (likeness >= CONFIRM)
    one = F.struct("line", F.when(sure, family).otherwise(F.lit("unknown")).alias("family"), F.round(best, 6).alias("confidence"), F.round(likeness, 6).alias("likeness"))
    return found.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), one))).alias("found")).drop("row")


def report(docs: DataFrame) -> DataFrame:
    """Per document: n_paragraphs (with vocabulary), n_notices, families (sorted, comma-joined), lines (line:family of each
    notice, comma-joined), and the confidence of the surest."""
    sure = F.filter("found", lambda x: x["family"] != "unknown")
    found = notices(docs).select("doc_id", sure.alias("s"), F.size("found").alias("n_paragraphs"))
    families = F.array_join(F.array_sort(F.array_distinct(F.col("s.family"))), ",")
    lines = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["line"].cast("string"), x["family"])), ",")
    return found.select("doc_id", F.col("n_paragraphs").cast("long").alias("n_paragraphs"), F.size("s").cast("long").alias("n_notices"), families.alias("families"), lines.alias("lines"), F.coalesce(F.array_max(F.col("s.confidence")), F.lit(0.0)).alias("confidence"))
