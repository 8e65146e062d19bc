"""Licence scan: a trained paragraph classifier, confirmed by template comparison, in DataFrame operations only.

Every non-blank line is a paragraph, and so is every block of several lines of a text that has blank lines, as
notices are often wrapped. Features are distinct words and pairs of adjacent words. A logistic regression over
the licence families and ``unknown`` is fitted on the driver to the templates below, to variants of them, and
to other text; its temperature is fitted to the answers for templates that the fit had not seen. On the cluster
a model is a small table, feature -> weights. A paragraph's probabilities depend on its number of words and on
which of its features the model knows; so these are cut out on the way, and each distinct combination is
scored once. A prediction is confirmed where the paragraph resembles a template of the predicted family.
"""

from __future__ import annotations

import functools
import math
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.runtime import broadcast_if_small, materialize

#: Short notices of public licences, by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND',
        "Distributed under the MIT/X11 terms.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Licensed under the BSD 3-Clause License.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GNU GPL, version 2 or later.",
        "Released under GPLv3.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
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
        "Released under CC0 1.0, dedicated to the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "proprietary": [
        "Copyright. All rights reserved.",
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying is strictly prohibited.",
    ],
}
#: Lines that speak of licences and the like without being one.
OTHER = [
    "You need a driving license to rent a car here.", "The fishing license costs ten dollars a year.",
    "She asked for permission to leave the room early.", "The warranty covers parts and labor for two years.",
    "Copyright law is taught in the second term.", "He has the right to remain silent.", "The city granted the permission last week.",
    "A licensed electrician should check the wiring.", "The redistribution of seats follows the census.",
    "Their license plate was registered in another state.", "The terms of the lease end in May.",
    "The public library is open on Sundays.", "Software updates are installed at night.", "The general met the public in the square.",
    "The commons were grazed by sheep.", "Version 3 of the timetable is out.", "Apache helicopters flew over the coast.",
    "The institute is in Massachusetts.", "It was a free concert and everybody came.", "The notice was nailed to the door.",
]
UNKNOWN, SEPARATORS = "unknown", r"[^a-z0-9]+"
MIN_PROBABILITY, MIN_SIMILARITY, SEED, FOLDS = 0.5, 0.6, 8, 3
CLASSES = [*TEMPLATES, UNKNOWN]


def words_of(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def features_of(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def _scale(words: int) -> float:
    """Value of each feature of a paragraph: its words and pairs together have length 1 if none repeats."""
    return 1 / math.sqrt(max(2 * words - 1, 1))


def _alike(words: list[str], template: str) -> bool:
    a, b = features_of(words), features_of(words_of(template))
    return 2 * len(a & b) >= MIN_SIMILARITY * (len(a) + len(b))


def _templates() -> list[tuple[int, int, str]]:
    """(class, number within the class, text)."""
    return [(k, i, t) for k, family in enumerate(CLASSES[:-1]) for i, t in enumerate(TEMPLATES[family])]


def _examples(rng: random.Random, turns: int, fold: int | None = None, held: bool = False) -> list[tuple[list[str], int]]:
    """Templates with a few words lost or added are their family; with most words lost or out of order, unknown.

    With ``fold`` only what is (``held``) or is not in that fold, by the number of the template or other text.
    """
    use = lambda i: fold is None or (i % FOLDS == fold) == held
    filler = sorted({w for x in OTHER for w in words_of(x)})
    out = []
    for k, i, text in _templates():
        if not use(i):
            continue
        words = words_of(text)
        for turn in range(turns):
            own = [w for w in words if turn == 0 or rng.random() > 0.12]
            for _ in range(rng.randrange(4) if turn else 0):
                own.insert(rng.choice([0, len(own)]), rng.choice(filler))
            out.append((own, k))
        lost = [w for w in words if rng.random() < 0.3]
        if not any(_alike(lost, t) for t in TEMPLATES[CLASSES[k]]):
            out.append((lost, len(CLASSES) - 1))
        mixed = words + rng.sample(filler, min(len(filler), 2 * len(words)))
        rng.shuffle(mixed)
        out.append((mixed, len(CLASSES) - 1))
    for i, text in enumerate(OTHER):
        if use(i):
            out += [([w for w in words_of(text) if rng.random() > 0.15], len(CLASSES) - 1) for _ in range(turns)]
    return out


def _matrix(examples: list[tuple[list[str], int]], vocabulary: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(examples), len(vocabulary)))
    for i, (words, _) in enumerate(examples):
        for f in features_of(words):
            if f in vocabulary:
                x[i, vocabulary[f]] = _scale(len(words))
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _fitted(train: list[tuple[list[str], int]], steps: int) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    vocabulary = {f: i for i, f in enumerate(sorted({f for words, _ in train for f in features_of(words)}))}
    x, y = _matrix(train, vocabulary), np.eye(len(CLASSES))[[k for _, k in train]]
    # weights stay sums of the examples: descend in the examples' shares, over their products
    products, shares, b = x @ x.T, np.zeros(y.shape), np.zeros(y.shape[1])
    for _ in range(steps):
        error = (_softmax(products @ shares + b) - y) / len(x)
        shares -= 30 * (error + 2e-5 * shares)
        b -= 30 * error.sum(0)
    return vocabulary, x.T @ shares, b


@functools.cache
def model() -> tuple[dict[str, list[float]], list[float], float]:
    """Weights by feature, biases, and the temperature; fitted by gradient descent with weight decay.

    The temperature makes the answers of FOLDS fits for the templates that each had left out likeliest.
    """
    logits, truth = [], []
    for fold in range(FOLDS):
        vocabulary, w, b = _fitted(_examples(random.Random(SEED + fold), 4, fold), 200)
        unseen = _examples(random.Random(SEED + 100 + fold), 3, fold, held=True)
        logits.append(_matrix(unseen, vocabulary) @ w + b)
        truth += [k for _, k in unseen]
    z = np.vstack(logits)
    heat = min(np.geomspace(0.3, 5, 40), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(z)), truth] + 1e-12).sum())
    vocabulary, w, b = _fitted(_examples(random.Random(SEED), 6), 600)
    return {f: w[i].round(6).tolist() for f, i in vocabulary.items()}, b.round(6).tolist(), round(float(heat), 6)


def _values(spark: SparkSession, rows: list[str], names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {','.join(rows)} AS t({names})")


def _pairs(words: Column, join) -> Column:
    next_ = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.filter(F.zip_with(words, next_, join), lambda p: p.isNotNull())


def _paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, kind, paragraph, words: lines, and blocks of several lines of texts with blank lines."""
    gap = r"\n[ \t\r]*\n"
    row = lambda kind: lambda t, i: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("paragraph"), t.alias("t"))
    lines = F.transform(F.split("text", "\n"), row("line"))
    wrapped = F.filter(F.transform(F.split("text", gap), row("block")), lambda b: F.contains(F.trim(b["t"]), F.lit("\n")))
    both = F.when(F.col("text").rlike(gap), F.concat(lines, wrapped)).otherwise(lines)
    rows = docs.select("doc_id", F.inline(both))
    rows = rows.select("doc_id", "kind", "paragraph", F.filter(F.split(F.lower("t"), SEPARATORS), lambda w: w != "").alias("words"), "t")
    return rows.where(F.trim(F.translate("t", "\t\r\n", "   ")) != "").drop("t")


def scan(docs: DataFrame) -> DataFrame:
    """One row per paragraph: doc_id, kind, paragraph, family, probability, template, similarity, confirmed.

    ``kind`` is ``line``, numbered from 0 with blank ones, or ``block``, numbered from 0 among the pieces between
    blank lines. ``family`` is the likeliest class, or ``unknown`` where its calibrated probability is under 0.5.
    ``template`` is the most similar one of that family and ``confirmed`` true where its similarity (Dice of the
    distinct features) is at least 0.6; ties take the greatest name. Null and empty texts have no paragraphs; a paragraph without
    words of a-z and 0-9 is classified by the biases alone; null and repeated ids are ordinary rows; an
    empty table gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    weights, bias, heat = model()
    single, double = sorted(f for f in weights if " " not in f), sorted(f for f in weights if " " in f)
    rows = _paragraphs(docs)
    words = F.col("words")
    known = lambda w: w.isin(single)
    pairs = _pairs(words, lambda a, b: F.when(known(a) & known(b), F.concat(a, F.lit(" "), b)))
    seen = F.array_distinct(F.concat(F.filter(words, known), F.filter(pairs, lambda p: p.isin(double))))
    rows = rows.withColumn("known", F.array_sort(seen)).withColumn("n", F.size("words"))
    # of n features 0.3 n must be a template's, or no similarity reaches 0.6: only then all are counted
    every = F.size(F.array_distinct(words)) + F.size(F.array_distinct(_pairs(words, lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))))
    few = F.size("known") >= (MIN_SIMILARITY / 2) * F.size(F.array_distinct(words))
    rows = rows.withColumn("features", F.when(few & (F.size("known") > 0), every))
    rows = materialize(rows.select("doc_id", "kind", "paragraph", "known", "n", "features"), "licence-paragraphs")
    key = ["known", "n", "features"]
    distinct = rows.select(*key).distinct()
    cells = [f"('{f}',array({','.join(map(str, v))}))" for f, v in weights.items()]
    table = _values(spark, cells, "feature, w")  # as many rows as the templates and other lines have features
    hits = distinct.select(*key, F.explode("known").alias("feature")).join(F.broadcast(table), "feature")
    sums = hits.groupBy(*key).agg(*(F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(CLASSES))))
    bare = distinct.where(F.size("known") == 0).select(*key, *(F.lit(0.0).alias(f"s{k}") for k in range(len(CLASSES))))
    scored = sums.unionByName(bare)
    scale = F.sqrt(F.greatest(2.0 * F.col("n") - 1, F.lit(1.0)))
    logit = [(F.col(f"s{k}") / scale + b) / heat for k, b in enumerate(bias)]
    scored = scored.select(*key, F.array(*logit).alias("logits")).withColumn("top", F.array_max("logits"))
    total = F.aggregate("logits", F.lit(0.0), lambda s, z: s + F.exp(z - F.col("top")))
    best = F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position("logits", F.col("top")).cast("int"))
    scored = scored.withColumn("probability", F.round(1 / total, 6)).withColumn(
        "family", F.when(F.col("probability") >= MIN_PROBABILITY, best).otherwise(F.lit(UNKNOWN))
    ).drop("logits", "top")
    shapes = [
        f"('{CLASSES[k]}','{CLASSES[k]}/{i}',array({','.join(repr(f) for f in sorted(features_of(words_of(t))))}))" for k, i, t in _templates()
    ]
    shapes = _values(spark, shapes, "s_family, template, shape")
    alike = F.size(F.array_intersect("known", "shape")) * 2.0 / (F.col("features") + F.size("shape"))
    near = scored.where("features is not null").join(F.broadcast(shapes), F.col("family") == F.col("s_family"))
    near = near.groupBy(*key).agg(F.max(F.struct(F.round(alike, 6).alias("similarity"), "template")).alias("m"))
    on = lambda a, b: (a["known"] == b["known"]) & (a["n"] == b["n"]) & a["features"].eqNullSafe(b["features"])
    a, b = scored.alias("a"), near.alias("b")
    verdict = a.join(b, (F.col("a.known") == F.col("b.known")) & (F.col("a.n") == F.col("b.n")) & (F.col("a.features") == F.col("b.features")), "left")
    verdict = materialize(verdict.select("a.*", F.col("m.template").alias("template"), F.col("m.similarity").alias("similarity")), "licence-verdicts")
    verdict = broadcast_if_small(verdict)
    found = rows.join(verdict, on(rows, verdict))
    return found.select(
        "doc_id", "kind", "paragraph", "family", "probability", "template", "similarity",
        F.coalesce(F.col("similarity") >= MIN_SIMILARITY, F.lit(False)).alias("confirmed"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
