"""Licence families of paragraphs, in DataFrame functions only.

A trained multinomial logistic regression over sparse word n-grams (1 to 3 words)
gives each paragraph (line) the probabilities of the licence families, of an
unknown licence and of no licence. A family counts only where its probability
reaches a threshold calibrated on held-out examples, and where the paragraph
holds enough of one of the family's templates; what fails either but is more
likely a licence than not is an unknown licence. Notices wrapped over several
lines are found by joining neighbouring lines that hold parts of one template.

Training is small and on the driver: variants of the templates below (words
dropped, cut, put among other words), statements of unnamed licences, and a
bounded sample of ``MAX_PLAIN`` lines, from as many texts, as plain text. Probabilities
and threshold are calibrated on examples held out of a first fit. Scanning covers
every line of every text: every n-gram of the model has a word that is special to
licences, so lines without one all have the score of an empty line; for the others the n-grams are joined to the
broadcast weights and templates, whose sizes the templates fix.

Defined cases: null and empty texts have no licence; a line may be of any length;
rows that repeat a doc_id each get a row with the same result as any of them
alone would have; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.portable import settled
from .common import identify, materialise, smallest_hashes

MAX_PLAIN = 400
VARIANTS = 14
#: Share of a template's pairs of words that a paragraph must hold to confirm it.
CONFIRM = 0.6
#: Most unknown or plain held-out examples that may pass as a family.
MAX_FALSE = 0.005
NONE, UNKNOWN = "none", "unknown"

#: Short notices by which the licence families are recognised.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": ("Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "This software is distributed under the MIT License, see the LICENSE file.", "The MIT License (MIT)"),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "This project is licensed under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license, see the LICENSE file."),
    "gpl-2": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2.", "Released under the GNU GPL version 2.", "SPDX-License-Identifier: GPL-2.0-only", "This software is distributed under the GNU General Public License v2."),
    "gpl-3": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3.", "Released under the GNU GPL version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "This software is distributed under the GNU General Public License v3."),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License.", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", "Released under the GNU LGPL.", "SPDX-License-Identifier: LGPL-2.1-or-later", "This software is distributed under the Lesser General Public License."),
    "agpl": ("This program is licensed under the GNU Affero General Public License.", "under the terms of the GNU Affero General Public License version 3", "Released under the GNU AGPL.", "SPDX-License-Identifier: AGPL-3.0-or-later", "This software is distributed under the Affero General Public License."),
    "bsd": ("Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Use of this source code is governed by a BSD-style license.", "SPDX-License-Identifier: BSD-3-Clause", "This software is distributed under the BSD 3-Clause License.", "This project is licensed under the terms of the BSD license."),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "This software is distributed under the Mozilla Public License.", "Released under the Mozilla Public License 2.0."),
    "isc": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC", "This software is distributed under the ISC license.", "This project is licensed under the terms of the ISC license."),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License.", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0", "This software is distributed under the Eclipse Public License.", "Released under the Eclipse Public License 2.0."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", "Released under the Unlicense.", "This software is distributed under the Unlicense and is in the public domain."),
    "cc0": ("Released under CC0 1.0 Universal public domain dedication.", "To the extent possible under law, the author has waived all copyright under Creative Commons CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "Licensed under CC0 1.0 Universal.", "This work is dedicated to the public domain under CC0 1.0."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "This document is available under CC BY 4.0.", "License: CC BY 4.0", "Content is published under the terms of CC BY 4.0.", "Except where otherwise noted, content is licensed under a Creative Commons Attribution 4.0 license.", "Released under the Creative Commons Attribution 4.0 International license (CC BY 4.0)."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "Text is available under the Creative Commons Attribution-ShareAlike 4.0 license.", "Released under the Creative Commons Attribution-ShareAlike 4.0 International license (CC BY-SA 4.0)."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Content is licensed under a Creative Commons Attribution-NonCommercial 4.0 license.", "Released under the Creative Commons Attribution-NonCommercial 4.0 International license (CC BY-NC 4.0)."),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0", "Content is licensed under a Creative Commons Attribution-NoDerivatives 4.0 license.", "Released under the Creative Commons Attribution-NoDerivatives 4.0 International license (CC BY-ND 4.0)."),
}
#: Statements that name no known family.
UNNAMED = (
    "Copyright, all rights reserved.", "Licensed under the terms of the accompanying agreement.", "This work is licensed to members only.",
    "Released under our own public license, version 1.", "Distributed under a proprietary license.", "The license may be terminated at any time.",
    "Redistribution in any form is prohibited.", "See the license file for details.", "You may not copy this software.",
)
#: Sentences of plain text with words that licences use.
EVERYDAY = (
    "The driver lost his license after the accident.", "She renewed her driving license last week.", "A fishing license costs twenty euros a year.",
    "The bar was granted a liquor license by the city.", "He took some license with the facts in his novel.", "The license plate of the car was covered with mud.",
    "Teachers need a license to work in this state.", "The company applied for a banking license in June.", "Poetic license allows a writer to bend the rules.",
    "The library is open to the public on Sundays.", "Copyright law has changed a lot since the last century.", "The software crashed twice while I was using it.",
    "The court had to decide who owns the copyright of the song.", "Permission to enter the building is given at the front desk.", "The general public knows little of this work.",
    "The source of the river lies in the northern mountains.", "You may use the bicycle if you bring it back by noon.", "He distributed copies of the program to all the guests.",
    "The terms of the treaty were made public in March.", "A pilot without a valid license must not fly.", "The station lost its broadcasting license over the scandal.",
    "Without limitation of time the contest was no longer any fun.", "The artist grants interviews only on her own terms.", "The version of the story that he told us was the third one.",
)
#: Words of the above that say nothing of licences, in any of the languages at hand; all others are cues, whatever the sample holds.
ORDINARY = frozenset("the of and in to is that it for be with by this are at or has all any can may not you only our own see mit nd".split())
#: Share of the pairs of words, of a line or of a template, that keeps a sampled line out of plain text; and their least number.
RESEMBLES, MIN_PAIRS = 0.5, 3
#: Between words; characters from U+0080 belong to them.
_BREAK = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
_SPACED = r"[^a-z0-9.\x{80}-\x{10FFFF}]+|\.(?![0-9])"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.sub("[^a-z0-9.\u0080-\U0010ffff]+|\\.(?![0-9])", " ", low).split(" ") if w]


def grams(tokens: list[str]) -> set[str]:
    return {" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)}


def pairs(tokens: list[str]) -> set[str]:
    return {" ".join(tokens[i : i + 2]) for i in range(len(tokens) - 1)}


def _short_runs(tokens: list[str]) -> set[str]:
    """Runs of two and three words, and words that are a name of their own."""
    return {g for g in grams(tokens) if " " in g} | {w for w in tokens if w not in ORDINARY and len(w) > 2}


def resembles(tokens: list[str]) -> bool:
    """Whether a line holds much of a template, or is much of one."""
    line = pairs(tokens)
    both = [(len(line & own), min(len(line), len(own))) for texts in TEMPLATES.values() for own in (pairs(words(x)) for x in texts)]
    return any(n >= MIN_PAIRS and n >= RESEMBLES * least for n, least in both)


class Model:
    """classes, weights by n-gram (a row each), intercepts, threshold, cue words."""

    def __init__(self, classes, vocabulary, weights, bias, threshold, cues):
        self.classes, self.vocabulary, self.weights, self.bias, self.threshold, self.cues = classes, vocabulary, weights, bias, threshold, cues

    def scores(self, tokens: list[str]) -> np.ndarray:
        at = [self.vocabulary[g] for g in grams(tokens) if g in self.vocabulary]
        return self.bias + self.weights[at].sum(0)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _variants(tokens: list[str], plain: list[list[str]], r: np.random.Generator, n: int) -> list[list[str]]:
    out = [tokens]
    for _ in range(n - 1):
        t = [w for w in tokens if r.random() > 0.12] or tokens
        if r.random() < 0.3 and len(t) > 6:
            cut = int(r.integers(len(t) // 2, len(t)))
            t = t[:cut] if r.random() < 0.5 else t[-cut:]
        if r.random() < 0.4 and plain:
            a, b = (plain[int(r.integers(len(plain)))][: int(r.integers(0, 15))] for _ in range(2))
            t = a + t + b
        out.append(t)
    return out


def _fit(examples: list[tuple[int, list[str]]], vocabulary: dict[str, int], n_classes: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts by gradient descent with momentum."""
    x, n = _matrix([t for _, t in examples], vocabulary), len(examples)
    y = np.zeros((n, n_classes), np.float32)
    y[np.arange(n), [k for k, _ in examples]] = 1
    w, b = np.zeros((len(vocabulary), n_classes), np.float32), np.zeros(n_classes, np.float32)
    vw, vb = w.copy(), b.copy()
    for _ in range(steps):
        gap = (_softmax(x @ w + b) - y) / n
        vw, vb = 0.9 * vw - 1.5 * (x.T @ gap + 1e-5 * w), 0.9 * vb - 1.5 * gap.sum(0)
        w, b = w + vw, b + vb
    return w, b


def _matrix(texts: list[list[str]], vocabulary: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(texts), len(vocabulary)), np.float32)
    for i, t in enumerate(texts):
        x[i, [vocabulary[g] for g in grams(t) if g in vocabulary]] = 1
    return x


def _vocabulary(examples: list[tuple[int, list[str]]], notices: list[list[str]], cues: set[str]) -> dict[str, int]:
    """N-grams of the notices that two examples or more hold; each has a cue, so a line without one has the intercepts for its score."""
    known: dict[str, int] = {}
    for _, t in examples:
        for g in grams(t):
            known[g] = known.get(g, 0) + 1
    own = {g for t in notices for g in grams(t) if known.get(g, 0) >= 2 and not cues.isdisjoint(g.split(" "))}
    return {g: i for i, g in enumerate(sorted(own))}


def _examples(plain_lines: list[str], seed: int) -> tuple[list[tuple[int, list[str], int]], list[str]]:
    """(class, words, number of what it is made of) and cue words."""
    r = np.random.default_rng(seed)
    plain = [t for t in (words(x) for x in plain_lines) if t]
    plain = [t for t in plain if not resembles(t)]
    cues = sorted({w for own in [*TEMPLATES.values(), UNNAMED] for x in own for w in words(x) if w not in ORDINARY and len(w) > 1 and not w[0].isdigit()})
    made = [(0, t[:60], i) for i, t in enumerate(plain)] + [(0, [], 1)]
    for i, x in enumerate(EVERYDAY):
        made += [(0, t, i) for t in _variants(words(x), plain, r, VARIANTS // 2)]
    # single words of licences also occur in plain text
    loose = [w for w in cues if not re.match("licen|copyright|redistribut|gpl|gnu|apache|mozilla|bsd", w)]
    for i, t in enumerate(plain):
        at = int(r.integers(0, len(t) + 1))
        made.append((0, [*t[:at][-40:], loose[int(r.integers(len(loose)))], *t[at:][:40]], i))
    for i, x in enumerate(UNNAMED):
        made += [(1, t, i) for t in _variants(words(x), plain, r, VARIANTS)]
    every = {name: set().union(*(_short_runs(words(x)) for x in texts)) for name, texts in TEMPLATES.items()}
    own = {name: runs.difference(*(other for n, other in every.items() if n != name)) for name, runs in every.items()}
    for k, name in enumerate(sorted(TEMPLATES), 2):
        for i, x in enumerate(TEMPLATES[name]):
            # a variant is of the family as long as it has a run of words that no other family has, or most of a template
            made += [(k if own[name] & _short_runs(t) or _similarity(t, name) >= CONFIRM else 1, t, i) for t in _variants(words(x), plain, r, VARIANTS)]
    return made, cues


def _fitted(examples: list[tuple[int, list[str]]], notices: list[str], cues: list[str], steps: int) -> Model:
    classes = [NONE, UNKNOWN, *sorted(TEMPLATES)]
    vocabulary = _vocabulary(examples, [words(x) for x in notices], set(cues))
    w, b = _fit(examples, vocabulary, len(classes), steps)
    return Model(classes, vocabulary, w.astype(float), b.astype(float), 0.5, cues)


def train(plain_lines: list[str], seed: int = 5, steps: int = 300) -> Model:
    """The model, calibrated on every fourth example, which a first fit has not seen: its temperature makes the
    probabilities of those likeliest, its threshold lets few pass that are no family.
    """
    made, cues = _examples(plain_lines, seed)
    every = [x for own in [*TEMPLATES.values(), UNNAMED] for x in own]
    held = np.random.default_rng(seed + 1).random(len(made)) < 0.25
    trial = _fitted([(k, t) for (k, t, _), out in zip(made, held) if not out], every, cues, steps)
    rest = [(k, t) for (k, t, _), out in zip(made, held) if out]
    scores, truth = np.array([trial.scores(t) for _, t in rest]), [k for k, _ in rest]
    loss = lambda heat: -np.log(np.maximum(1e-12, _softmax(scores / heat)[np.arange(len(truth)), truth])).mean()
    heat = float(min(np.geomspace(0.25, 8, 41), key=loss))
    # what is no family must not pass by its probability, whatever the template check would say
    passing = [v[2:].max() for v, (k, _) in zip(_softmax(scores / heat), rest) if k < 2]
    model = _fitted([(k, t) for k, t, _ in made], every, cues, steps)
    model.weights, model.bias = model.weights / heat, model.bias / heat
    model.threshold = float(next((v for v in np.linspace(0.2, 0.99, 80) if sum(q >= v for q in passing) <= MAX_FALSE * len(passing)), 0.99))
    return model


def unseen_templates(plain_lines: list[str], seed: int = 5, steps: int = 300) -> tuple[int, int, int]:
    """Of notices like the last template of each family with several, which a fit has not seen: all, taken for a licence, and for the right one."""
    made, cues = _examples(plain_lines, seed)
    families = [(), (), *(TEMPLATES[name] for name in sorted(TEMPLATES))]
    last = [k > 1 and i == len(families[k]) - 1 > 0 for k, _, i in made]
    notices = [x for own in families[2:] for x in own[: max(1, len(own) - 1)]] + list(UNNAMED)
    model = _fitted([(k, t) for (k, t, _), out in zip(made, last) if not out], notices, cues, steps)
    found = [(k, int(model.scores(t).argmax())) for (k, t, _), out in zip(made, last) if out]
    return len(found), sum(c > 0 for _, c in found), sum(c == k for k, c in found)


def _similarity(tokens: list[str], family: str) -> float:
    """Largest share of a template of the family that the tokens hold."""
    own = pairs(tokens)
    return max(len(own & pairs(words(x))) / len(pairs(words(x))) for x in TEMPLATES[family])


def _lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def plain_sample(rows: DataFrame) -> list[str]:
    """Lines of 30 to 300 characters that name no licence (train leaves out those that resemble a template), from the MAX_PLAIN texts with the smallest hashes; the first MAX_PLAIN by hash."""
    some = smallest_hashes(rows, "row", MAX_PLAIN, rows.count())
    lines = some.select(F.explode(F.split("text", "\n", -1)).alias("line")).filter("length(line) BETWEEN 30 AND 300")
    lines = lines.filter(~_lowered(F.col("line")).rlike("licen[sc]|copyright|redistribut|public domain|creative commons"))
    found = lines.distinct().orderBy(F.xxhash64("line"), "line").limit(MAX_PLAIN).collect()
    return [r[0] for r in found]


def _runs(n: int) -> Column:
    """The runs of n words of w."""
    return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))


def _tokens(line: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(_lowered(line), _SPACED, " "), " ", -1), lambda w: w != "")


def _scores(found: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """family and its probability for all keys whose grams are more likely a licence than not."""
    k = len(model.classes)
    weights = found.sparkSession.createDataFrame([(g, model.weights[i].tolist()) for g, i in model.vocabulary.items()], "gram string, weights array<double>")
    sums = found.join(F.broadcast(weights), "gram").groupBy(*keys).agg(*[F.sum(F.col("weights")[c]).alias(f"s{c}") for c in range(k)])
    score = [F.col(f"s{c}") + float(model.bias[c]) for c in range(k)]
    # each step settled, or the optimiser would write the steps before into every element of the next
    scored = settled(sums.select(*keys, F.array(*score).alias("s")).withColumn("m", F.array_max("s")))
    scored = settled(scored.withColumn("e", F.transform("s", lambda v: F.exp(v - F.col("m")))))
    scored = settled(scored.withColumn("z", F.aggregate("e", F.lit(0.0), lambda a, v: a + v)))
    scored = settled(scored.withColumn("p", F.transform("e", lambda v: v / F.col("z"))))
    families = F.slice("p", 3, k - 2)
    scored = scored.withColumn("best", F.array_max(families)).withColumn("which", F.array_position(families, F.array_max(families)).cast("int") + 1)
    names = F.array(*[F.lit(c) for c in model.classes])
    return scored.filter(F.col("p")[0] < 0.5).select(*keys, F.get(names, F.col("which")).alias("family"), F.col("best").alias("probability"))


def scan_lines(rows: DataFrame, model: Model) -> DataFrame:
    """row, line_no, family (a name or unknown), probability, similarity of every line that is more likely a licence than not.

    Notices wrapped over several lines have one row, at their first line; their other lines have none.
    """
    spark = rows.sparkSession
    lines = F.split("text", "\n", -1)
    # each line with the one after it, whose beginning continues its runs of words
    lines = rows.select("row", F.posexplode(F.arrays_zip(lines.alias("line"), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))).alias("next"))).alias("line_no", "both")).select("row", "line_no", "both.line", "both.next")
    low = _lowered(F.col("line"))
    lines = lines.filter(F.exists(F.split(low, _BREAK, -1), lambda w: w.isin(model.cues)))
    lines = settled(lines.select("row", "line_no", _tokens(F.col("line")).alias("own"), F.coalesce(F.slice(_tokens(F.col("next")), 1, 2), F.array().cast("array<string>")).alias("after")))
    lines = settled(lines.select("row", "line_no", "own", F.concat("own", "after").alias("w")))
    lines = settled(lines.select("row", "line_no", "own", F.size("own").alias("n"), *[_runs(n).alias(f"runs{n}") for n in (2, 3)]))
    # runs that end within the line come first, the others are those across its end
    part = lambda n: F.slice(f"runs{n}", 1, F.greatest(F.col("n") - (n - 1), F.lit(0)))
    rest = lambda n: F.slice(f"runs{n}", F.greatest(F.col("n") - (n - 2), F.lit(1)), F.least(F.col("n"), F.lit(n - 1)))
    cell = lambda across: lambda g: F.struct(g.alias("gram"), F.lit(across).alias("across"))
    inner = F.transform(F.array_distinct(F.concat(F.col("own"), part(2), part(3))), cell(False))
    outer = F.transform(F.array_distinct(F.concat(rest(2), rest(3))), cell(True))
    # only what the model or a template knows goes on: the other n-grams weigh nothing
    names = set(model.vocabulary).union(*(pairs(words(x)) for texts in TEMPLATES.values() for x in texts))
    names = spark.createDataFrame([(g,) for g in sorted(names)], "gram string")
    every = lines.select("row", "line_no", F.inline(F.concat(inner, outer))).join(F.broadcast(names), "gram", "left_semi")
    every = materialise(every.select("row", "line_no", "gram", "across"), "license-grams")
    found = every.filter("NOT across").drop("across")

    scored = _scores(found, model, ["row", "line_no"])
    templates = [(name, k, g, float(len(own))) for name, texts in TEMPLATES.items() for k, own in enumerate(pairs(words(x)) for x in texts) for g in own]
    known = spark.createDataFrame(templates, "family string, template int, gram string, size double")
    held = found.join(F.broadcast(known), "gram").groupBy("row", "line_no", "family", "template").agg((F.count("*") / F.max("size")).alias("similarity"))
    held = held.groupBy("row", "line_no", "family").agg(F.max("similarity").alias("similarity"))
    both = scored.join(held, ["row", "line_no", "family"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    sure = (F.col("probability") >= model.threshold) & (F.col("similarity") >= CONFIRM)
    single = materialise(both.withColumn("family", F.when(sure, F.col("family")).otherwise(F.lit(UNKNOWN))), "license-lines")
    wrapped = materialise(_wrapped(every, single, known, model), "license-wrapped")
    # a line of a wrapped notice says nothing of its own
    covered = wrapped.select("row", F.explode(F.sequence("line_no", "last")).alias("line_no"))
    return single.join(covered, ["row", "line_no"], "left_anti").unionByName(wrapped.drop("last"))


def _wrapped(every: DataFrame, single: DataFrame, known: DataFrame, model: Model) -> DataFrame:
    """row, line_no, last, family, probability, similarity of notices that only their lines together confirm.

    Lines next to each other that hold word pairs of one template are a stretch, without those that a family
    has on their own; blank lines hold none, so no stretch leaves its paragraph. A stretch is decided as a line is.
    """
    spot = ["row", "family", "template"]
    hits = every.join(F.broadcast(known), "gram").join(single.filter(F.col("family") != UNKNOWN).select("row", "line_no"), ["row", "line_no"], "left_anti")
    near = hits.groupBy(*spot, "line_no").agg(F.max("across").alias("across"), F.collect_set("gram").alias("grams"), F.max("size").alias("size"))
    order = Window.partitionBy(*spot).orderBy("line_no")
    near = near.withColumn("new", F.coalesce((F.col("line_no") - F.lag("line_no").over(order) > 1).cast("int"), F.lit(1))).withColumn("stretch", F.sum("new").over(order))
    ends = F.max(F.col("line_no") + F.col("across").cast("int")).alias("last")
    joined = near.groupBy(*spot, "stretch").agg(F.min("line_no").alias("line_no"), ends, (F.size(F.array_distinct(F.flatten(F.collect_list("grams")))) / F.max("size")).alias("similarity"))
    joined = joined.filter((F.col("similarity") >= CONFIRM) & (F.col("last") > F.col("line_no")))
    joined = materialise(joined.groupBy("row", "line_no", "last", "family").agg(F.max("similarity").alias("similarity")), "license-stretches")

    # stretches of one template share no line, so each line has a stretch a template at most
    part = joined.select("row", F.col("line_no").alias("first"), "last").distinct()
    part = part.select("row", "first", "last", F.explode(F.sequence("first", "last")).alias("line_no"))
    inside = ~(F.col("across") & (F.col("line_no") == F.col("last")))
    grams_of = every.join(part, ["row", "line_no"]).filter(inside).select("row", "first", "last", "gram").distinct()
    scored = _scores(grams_of, model, ["row", "first", "last"]).withColumnRenamed("first", "line_no")
    good = joined.join(scored.filter(F.col("probability") >= model.threshold), ["row", "line_no", "last", "family"])
    # of stretches that share lines, the longest stays, of equal ones the surest
    cells = good.withColumn("rank", F.struct((F.col("last") - F.col("line_no")).alias("length"), "probability", "similarity", "line_no", "last", "family"))
    best = cells.select("row", "rank", F.explode(F.sequence("line_no", "last")).alias("at")).groupBy("row", "at").agg(F.max("rank").alias("top"))
    lost = cells.select("row", "rank", F.explode(F.sequence("line_no", "last")).alias("at")).join(best, ["row", "at"]).filter("rank < top").select("row", "rank").distinct()
    return cells.join(lost, ["row", "rank"], "left_anti").select("row", "line_no", "last", "family", "probability", "similarity")


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model: Model | None = None) -> DataFrame:
    """row, doc_id, families (sorted names, unknown included), n_paragraphs (lines that state a licence; a wrapped notice counts once), probability (least of them)."""
    rows = identify(docs, text, doc_id)
    model = model or train(plain_sample(rows))
    found = scan_lines(rows, model).groupBy("row").agg(F.array_sort(F.collect_set("family")).alias("families"), F.count("*").alias("n_paragraphs"), F.min("probability").alias("probability"))
    return rows.select("row", "doc_id").join(found, "row", "left").select("row", "doc_id", F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), "probability")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.concat_ws(",", "families").alias("families"), "n_paragraphs", F.round("probability", 4).alias("probability"))


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLE_SQL: dict[str, str] = {}
