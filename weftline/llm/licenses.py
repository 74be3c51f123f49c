"""Licence scans by a trained paragraph classifier. DataFrame functions only where documents are read.

A multinomial logistic regression over sparse word n-grams tells the licence
family of a line and of a paragraph (the lines between two blank ones, joined,
so that a wrapped notice is whole), with a class for everything else. It is
trained by the driver on the notices below, in varied surroundings, and on a
bounded sample of the corpus's lines. Notices that a first model hasn't seen
set a temperature, so that the probability of the unknown class is calibrated.
A prediction is confirmed by the share of a notice's three-word shingles that
the line or paragraph holds.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import bind, read_table
from weftline.llm.decontamination import tokens

#: Usual notices of each family.
NOTICES = {
    "agpl-3.0": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Licensed under the AGPL v3.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Licensed under the BSD 2-Clause License.",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "http://creativecommons.org/licenses/by/4.0/",
        "Available under the CC-BY 4.0 license.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "http://creativecommons.org/licenses/by-nc/4.0/",
        "Available under the CC-BY-NC 4.0 license.",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "http://creativecommons.org/licenses/by-sa/4.0/",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal, public domain dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "either version 2 of the GNU General Public License, or (at your option) any later version",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Released under the GPL v2.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL v3.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary",
        "SPDX-License-Identifier: Unlicense",
    ],
}
#: Sentences about licences that grant none.
NOT_NOTICES = [
    "All rights reserved.",
    "Copyright 2020 by the authors, all rights reserved.",
    "The driver must show a valid license.",
    "A license is required for each user.",
    "The license plate was found under the car.",
    "This article is about software and public policy.",
    "The version of the work that was released last year.",
    "The terms of the agreement are subject to change without notice.",
    "Please read the license before you use the library.",
    "The general public is free to use the garden.",
    "Released under the name of the first author.",
    "Version 2.0 was released in the spring.",
    "The foundation published the terms of the award.",
]
FAMILIES = sorted(NOTICES)
SAMPLE_DOCS, SAMPLE_PARAGRAPHS, SAMPLE_WORDS = 1000, 3000, 400
VARIANTS = 24
COMMON_SHARE = 0.01
#: The highest probability of the unknown class in a prediction, and the least share of a notice that confirms one.
UNKNOWN, CONFIRMED = 0.5, 0.5


def grams(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for n in (1, 2) for i in range(len(words) - n + 1)}


def triples(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + 3]) for i in range(max(len(words) - 2, 1))} if words else set()


def plain_tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def lines_of(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, line, w): the words of every line that has any; lines are numbered from 0."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "s"))
    return lines.select("id", "line", tokens(F.col("s")).alias("w")).where(F.size("w") > 0)


def paragraphs(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(row, id, paragraph, w): of every paragraph its lines, each the array of its words. Rows have a key of their own, whatever their ids."""
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    runs = d.select("row", "id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n")).alias("paragraph", "run"))
    return runs.select("row", "id", "paragraph", F.transform(F.split("run", "\n"), tokens).alias("w"))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, kinds: int) -> np.ndarray:
    """Weights of a multinomial logistic regression by gradient descent with momentum; equal rows count once, with their number."""
    xs, at, n = np.unique(np.c_[x, y], axis=0, return_index=True, return_counts=True)
    xs, ys, weight = xs[:, :-1], y[at], n / n.sum()
    w, speed = np.zeros((xs.shape[1], kinds)), 0.0
    for _ in range(400):
        p = softmax(xs @ w)
        p[np.arange(len(ys)), ys] -= 1
        speed = 0.9 * speed - 1.0 * (xs.T @ (p * weight[:, None]) + 2e-5 * w)
        w = w + speed
    return w


def with_held(notices: list[str]) -> list[tuple[str, bool]]:
    """The notices of a family and whether they are held out: the last of which the others have half the n-grams, since no model can tell one from nothing."""
    can = []
    for i, t in enumerate(notices):
        mine, others = grams(plain_tokens(t)), {g for o in notices[:i] + notices[i + 1 :] for g in grams(plain_tokens(o))}
        can.append(2 * len(mine & others) >= len(mine))
    last = max((i for i, c in enumerate(can) if c), default=-1)
    return [(t, i == last) for i, t in enumerate(notices)]


def train(ordinary: list[list[str]], seed: int = 6, without: frozenset[str] = frozenset()) -> tuple[dict[tuple[str, ...], np.ndarray], np.ndarray]:
    """Weights of n-grams and the constant of each class, divided by the temperature; the last class is the unknown one.

    ``ordinary``: lines of the corpus. Those that hold most of a notice are
    left out; n-grams that are common among the others are no features. The
    temperature is the one under which a model without some notices (see
    with_held) and without a fourth of the lines tells these best; the weights
    are then fitted to everything but the notices ``without``.
    """
    rng = np.random.default_rng(seed)
    notices = [(k, plain_tokens(t), held) for k, name in enumerate(FAMILIES) for t, held in with_held([t for t in NOTICES[name] if t not in without])]
    known = [triples(w) for _, w, _ in notices]
    ordinary = [w for w in ordinary if all(len(t & triples(w)) < 0.5 * len(t) for t in known)]
    seen: dict[tuple[str, ...], int] = {}
    for w in ordinary:
        for g in grams(w):
            seen[g] = seen.get(g, 0) + 1
    vocabulary = sorted({g for _, w, _ in notices for g in grams(w) if seen.get(g, 0) <= COMMON_SHARE * max(len(ordinary), 1)})
    number = {g: i for i, g in enumerate(vocabulary)}
    pool = [x for w in ordinary[:500] for x in w] or ["a"]
    unknown = len(FAMILIES)
    rows: list[tuple[int, list[str], bool]] = []
    for k, w, last in notices:
        for v in range(VARIANTS):
            around = [list(rng.choice(pool, rng.integers(0, 12))) if v else [] for _ in range(2)]
            cut = rng.integers(0, max(len(w) // 5, 1)) if v % 3 == 2 else 0
            rows.append((k, [*around[0], *w[cut:], *around[1]], last))
    rows += [(unknown, w, i % 4 == 3) for i, w in enumerate(ordinary)] + [(unknown, plain_tokens(t), i % 4 == 3) for i, t in enumerate(NOT_NOTICES) for _ in range(8)]
    x = np.zeros((len(rows), len(vocabulary) + 1))
    x[:, -1] = 1
    for i, (_, w, _) in enumerate(rows):
        x[i, [number[g] for g in grams(w) if g in number]] = 1
    y, held = np.array([k for k, _, _ in rows]), np.array([h for _, _, h in rows])
    z, yh = x[held] @ fit(x[~held], y[~held], unknown + 1), y[held]
    losses = [(-np.log(softmax(z / t)[np.arange(len(yh)), yh] + 1e-12).mean(), t) for t in np.linspace(0.3, 3.0, 28)]
    w = fit(x, y, unknown + 1) / min(losses)[1]
    return {g: w[i] for g, i in number.items() if np.abs(w[i]).max() > 0.01}, w[-1]


def lookup(spark: SparkSession, weights: dict[tuple[str, ...], np.ndarray]) -> DataFrame:
    """One row for each n-gram that says anything: its hash, the classes' weights and the notices it is a shingle of.

    Its size is bounded by the notices, some thousand rows.
    """
    rows: dict[tuple[str, ...], dict] = {}
    for g, w in weights.items():
        rows[g] = {"g": list(g), "w": [float(x) for x in w], "t": []}
    for number, t in enumerate(t for name in FAMILIES for t in NOTICES[name]):
        for g in triples(plain_tokens(t)):
            rows.setdefault(g, {"g": list(g), "w": [0.0] * (len(FAMILIES) + 1), "t": []})["t"].append(number)
    text = json.dumps([rows[g] for g in sorted(rows)])
    table = spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<struct<g array<string>, w array<double>, t array<int>>>")).alias("r")).select("r.*")
    return table.select(F.xxhash64(*(F.get("g", F.lit(i)) for i in range(3))).alias("h"), "w", "t")


def gram_hashes(lines: Column) -> Column:
    """(h, line) of the 1-, 2- and 3-grams of a paragraph, an array of lines that are arrays of words; line is null where one goes over a line's end."""

    def of(w: Column, at: Column) -> Column:
        def gram(n: int):
            last = lambda i: F.get(at, i + (n - 1))
            hashed = lambda x, i: F.struct(F.xxhash64(x, *(F.get(w, i + j) for j in range(1, n))).alias("h"), F.when(F.get(at, i) == last(i), F.get(at, i)).alias("line"))
            return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0))), hashed)

        return F.concat(gram(1), gram(2), gram(3))

    numbered = F.flatten(F.transform(lines, lambda x, i: F.transform(x, lambda _: i)))
    return bind(F.flatten(lines), lambda w: bind(numbered, lambda at: of(w, at)))


def sampled(docs: DataFrame, text: str, id_col: str) -> list[list[str]]:
    """At most SAMPLE_PARAGRAPHS lines of at most SAMPLE_WORDS words, of about SAMPLE_DOCS documents, both chosen by a hash.

    The share of the documents is fixed by their number before anything is
    sorted, so that no task sends more to the driver where there are more tasks.
    """
    n = docs.count()
    drawn = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(6)), 11) < F.lit(int(min(1.0, SAMPLE_DOCS / max(n, 1)) * 2**53))
    p = lines_of(docs.where(drawn), text, id_col).where(F.size("w") <= SAMPLE_WORDS)
    rows = p.orderBy(F.xxhash64("id", "line", F.lit(6)), "id", "line").limit(SAMPLE_PARAGRAPHS).select("w").collect()
    return [list(r["w"]) for r in rows]


def licenses(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, paragraph, line, family, probability, unknown_probability, notice_share, confirmed): every line and paragraph that is predicted to be of a licence family.

    Paragraphs are what blank lines part, numbered from 0, and lines are
    numbered within them; null and blank texts have none. Predicted are those
    whose likeliest class is a family and whose probability of the unknown
    class is at most UNKNOWN;
    ``confirmed`` says whether they hold CONFIRMED of the shingles of one of
    its notices. A paragraph (its line is null) is reported where it is
    confirmed and no line of it alone is, for that family: a notice over
    several lines. Each row of ``docs`` is a document of its own, whatever its
    id; null ids are carried along. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    p = paragraphs(docs, text, id_col)
    weights, constant = train(sampled(docs, text, id_col))
    notices = [(k, len(triples(plain_tokens(t)))) for k, name in enumerate(FAMILIES) for t in NOTICES[name]]
    hits = p.select("row", "id", "paragraph", F.explode(gram_hashes(F.col("w"))).alias("g")).select("row", "id", "paragraph", "g.line", "g.h")
    hits = hits.join(F.broadcast(lookup(spark, weights)), "h").select("row", "id", "paragraph", "line", "h", "w", "t")
    both = hits.select("row", "id", "paragraph", F.explode(F.array(F.col("line"), F.lit(-1))).alias("line"), "h", "w", "t").where("line IS NOT NULL")
    once = both.groupBy("row", "paragraph", "line", "h").agg(F.first("id").alias("id"), F.first("w").alias("w"), F.first("t").alias("t"))
    sums = [F.sum(F.get("w", F.lit(k))).alias(f"z{k}") for k in range(len(FAMILIES) + 1)]
    counts = [F.sum(F.array_contains("t", t).cast("int")).alias(f"t{t}") for t in range(len(notices))]
    scored = once.groupBy("row", "paragraph", "line").agg(F.first("id").alias("id"), *sums, *counts)
    z = F.array(*((F.round(F.col(f"z{k}"), 9) + float(constant[k])) for k in range(len(FAMILIES) + 1)))
    share = F.array(*(F.greatest(*(F.col(f"t{t}") / float(n) for t, (of, n) in enumerate(notices) if of == k), F.lit(0.0)) for k in range(len(FAMILIES))))
    scored = scored.select("row", "id", "paragraph", "line", z.alias("z"), share.alias("share"))
    scored = scored.withColumn("e", bind(F.array_max("z"), lambda m: F.transform("z", lambda x: F.exp(x - m))))
    scored = scored.withColumn("p", bind(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), lambda s: F.transform("e", lambda x: x / s)))
    scored = scored.withColumn("best", F.array_max("p")).withColumn("k", F.array_position("p", F.col("best")).cast("int") - 1)
    scored = scored.where((F.col("k") < len(FAMILIES)) & (F.get("p", F.lit(len(FAMILIES))) <= UNKNOWN)).withColumn("confirmed", F.get("share", F.col("k")) >= CONFIRMED)
    alone = F.max((F.col("line") >= 0) & F.col("confirmed")).over(Window.partitionBy("row", "paragraph", "k"))
    scored = scored.withColumn("alone", alone).where((F.col("line") >= 0) | (F.col("confirmed") & ~F.col("alone")))
    return scored.select(
        F.col("id").alias(id_col), "paragraph", F.when(F.col("line") >= 0, F.col("line")).alias("line"), F.get(F.array(*map(F.lit, FAMILIES)), F.col("k")).alias("family"),
        F.col("best").alias("probability"), F.get("p", F.lit(len(FAMILIES))).alias("unknown_probability"), F.get("share", F.col("k")).alias("notice_share"), "confirmed",
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence lines and paragraphs of all documents; see licenses."""
    return licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
