"""Licence scan: a trained paragraph classifier, scored by DataFrame functions only.

A paragraph is a line of a text.  Its features are the word n-grams (one to three words)
that hold a licence word, present or absent; paragraphs without any marker have none and
are never licence notices.  A multinomial logistic regression over these sparse features
names the licence family or ``none``.  It is fitted on the driver to variants of the
notices below and to a bounded sample of corpus paragraphs that have markers but share
no three-word run with a notice.  The unknown class is calibrated by leaving families
out: a paragraph whose best probability is below the threshold that parts notices of
families seen from notices of families unseen is ``unknown``.  A prediction stands only
if the paragraph shares enough of its n-grams with a notice of that family; otherwise it
is ``unknown`` too.

One pass over the texts writes a row per document with its lines that hold a marker, which
settles the rows; everything else is computed from that table.

Scoring is built from functions of Spark SQL: no Python runs on the executors.

Defined results: null, empty and blank texts have no paragraphs and the family null;
very long lines are one paragraph, of which only the n-grams around licence words are
made; every row of the input has one row of output, repeated rows and null ids too; of
notices of equal rank the first of a text decides its family; an empty table gives an empty
result; columns beside id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, only

#: Notices by family.
NOTICES: dict[str, tuple[str, ...]] = {
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "apache": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GNU GPL v3 or later.", "Released under the GNU General Public License, version 2."),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Licensed under the LGPL, version 2.1."),
    "agpl": ("Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Released under the AGPL license."),
    "bsd": ("Licensed under the BSD 3-Clause License.", "Released under the 2-clause BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "Released under the Mozilla Public License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Released under the Creative Commons BY-NC license."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."),
    "public-domain": ("This work is dedicated to the public domain.", "Released into the public domain under CC0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    "proprietary": ("All rights reserved.", "Copyright 2020 Example Corporation. All rights reserved.", "This document is proprietary and confidential. No license is granted without written permission."),
}
#: A paragraph with none of these (lower case) has no features.
MARKERS = ("licen", "copyright", "gnu ", "gpl", "apache", "mozilla", "bsd", "creative commons", "permission", "redistribut", "reserved", "public domain", "cc by", "cc-by", "cc0", "proprietary")
#: Beginnings of licence words.
WORD = "licen|copyright|gnu$|gpl|lgpl|agpl|apache|mozilla|mpl$|bsd|creative$|commons$|permission|redistribut|reserved$|domain$|cc$|cc0$|proprietary|noncommercial|affero"
#: Openings that notices are varied with.
_BEFORE = ("", "This project is ", "The code is ", "Note: ")
_AFTER = ("", " See the LICENSE file.", " Please read it.")
#: At most so many corpus paragraphs are learnt from as negatives.
NEGATIVES = 300
CONFIRM = 0.3
FAMILIES = tuple(NOTICES)
NONE = len(FAMILIES)


def words_of(paragraph: str) -> list[str]:
    return [w for w in re.sub("[^a-z0-9.]+", " ", paragraph.lower()).split(" ") if w.strip(".")]


def grams_of(paragraph: str) -> set[str]:
    """The features of a paragraph, as ``gram_column`` makes them."""
    if not any(m in paragraph.lower() for m in MARKERS):
        return set()
    w = [x.strip(".") for x in words_of(paragraph)]
    out = set()
    for i, x in enumerate(w):
        if re.match(WORD, x):
            for size in (1, 2, 3):
                out |= {" ".join(w[a : a + size]) for a in range(max(0, i - size + 1), min(i, len(w) - size) + 1)}
    return out


@dataclass
class LicenceModel:
    """Weights by n-gram and class (the families, then none), class offsets, unknown threshold."""

    weights: dict[str, list[float]]
    offsets: list[float]
    threshold: float

    def probabilities(self, grams: set[str]) -> np.ndarray:
        z = np.array(self.offsets) + sum((np.array(self.weights[g]) for g in sorted(grams) if g in self.weights), np.zeros(NONE + 1))
        e = np.exp(z - z.max())
        return e / e.sum()


def _solve(sets: list[set[str]], y: np.ndarray, vocabulary: dict[str, int], steps: int = 400, l2: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(sets), len(vocabulary)), np.float32)
    for r, s in enumerate(sets):
        x[r, [vocabulary[g] for g in s if g in vocabulary]] = 1
    goal = np.eye(NONE + 1, dtype=np.float32)[y]
    weight = (1 / np.maximum(1, goal.sum(0))[y])[:, None]
    weight /= weight.sum()
    w, b = np.zeros((x.shape[1], NONE + 1), np.float32), np.zeros(NONE + 1, np.float32)
    m1, m2, n1, n2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = weight * (p - goal)
        gw, gb = x.T @ g + l2 * w, g.sum(0)
        m1, m2, n1, n2 = 0.9 * m1 + 0.1 * gw, 0.999 * m2 + 0.001 * gw * gw, 0.9 * n1 + 0.1 * gb, 0.999 * n2 + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.15 * (m1 / a) / (np.sqrt(m2 / c) + 1e-8)
        b -= 0.15 * (n1 / a) / (np.sqrt(n2 / c) + 1e-8)
    return w, b


def fit(negatives: list[str]) -> LicenceModel:
    """Fits the classifier and calibrates its unknown class by leaving families and notices out, a third at a time.

    A fit without some families and without some notices of the others tells how sure it is
    of notices of families it knows and of families it does not; neither is judged on what
    it was fitted to.
    """
    sets, y, part_of = [], [], []
    for k, family in enumerate(FAMILIES):
        for n, notice in enumerate(NOTICES[family]):
            for a in _BEFORE:
                for z in _AFTER:
                    sets.append(grams_of(a + notice + z))
                    y.append(k)
                    part_of.append(n % 3)
    plain = ["The committee gave permission to build a licensed restaurant.", "You need a licence to drive.", "Seats are reserved for members.", "A library of public records.", "The driver lost his license.", ""]
    for text in [*plain, *negatives]:
        sets.append(grams_of(text))
        y.append(NONE)
        part_of.append(-1)
    y, part_of = np.array(y), np.array(part_of)
    vocabulary = {g: i for i, g in enumerate(sorted({g for s, k in zip(sets, y, strict=True) if k != NONE for g in s}))}
    w, b = _solve(sets, y, vocabulary)
    names = list(vocabulary)
    model = LicenceModel({n: [float(v) for v in w[i]] for n, i in vocabulary.items()}, [float(v) for v in b], 0.5)
    known, unseen = [], []
    for part in range(3):
        strange = (y != NONE) & (y % 3 == part)
        aside = (y != NONE) & ~strange & (part_of == (part + y) % 3)
        keep = np.flatnonzero(~strange & ~aside)
        wp, bp = _solve([sets[i] for i in keep], y[keep], vocabulary, steps=400)
        some = LicenceModel({n: [float(v) for v in wp[i]] for n, i in zip(names, range(len(names)), strict=True)}, [float(v) for v in bp], 0.5)
        for i in np.flatnonzero(strange | aside):
            best = float(some.probabilities(sets[i])[:NONE].max())
            (unseen if strange[i] else known).append(best)
    # Between what most held-out notices of known families reach and what most notices of unknown families stay below.
    model.threshold = float(np.clip((np.quantile(known, 0.1) + np.quantile(unseen, 0.9)) / 2, 0.3, 0.9))
    return model


def _local(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table from literals; nothing of it runs in Python."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def has_marker(text: Column) -> Column:
    """Whether a text holds a marker; the lambda over an array of one binds the lower-cased text, which is made once."""
    def any_of(low: Column) -> Column:
        out = F.lit(False)
        for m in MARKERS:
            out = out | F.contains(low, F.lit(m))
        return out

    return F.element_at(F.transform(F.array(F.lower(text)), any_of), 1)


def gram_column(paragraph: Column) -> Column:
    """Distinct n-grams of one to three words that hold a licence word."""
    clean = F.regexp_replace(F.lower(paragraph), "[^a-z0-9.]+", " ")
    words = F.filter(F.transform(F.split(clean, " "), lambda x: F.trim(x, F.lit("."))), lambda x: x != "")
    spans = [(a, n) for n in (1, 2, 3) for a in range(n)]

    def around(w: Column, i: Column) -> Column:
        pieces = [F.when((i - a >= 0) & (i - a + n <= F.size(w)), F.array_join(F.slice(w, F.greatest(i - a, F.lit(0)) + 1, F.lit(n)), " ")) for a, n in spans]
        return F.array_compact(F.array(*pieces))

    def of(w: Column) -> Column:
        spots = F.filter(F.transform(w, lambda x, i: F.when(x.rlike(f"^(?:{WORD})"), i)), lambda i: i.isNotNull())
        return F.array_distinct(F.flatten(F.transform(spots, lambda i: around(w, i))))

    # A lambda over an array of one binds the words, which are then made once.
    return F.element_at(F.transform(F.array(words), of), 1)


def marked_lines(docs: DataFrame) -> DataFrame:
    """row (a number), doc_id and the marked lines with their places of every row of ``docs``; to be written before use, as the number is drawn."""
    lines = F.transform(F.split("text", "\n"), lambda line, place: F.struct(place.alias("place"), line.alias("line")))
    kept = F.when(has_marker(F.col("text")), F.filter(lines, lambda x: has_marker(x["line"])))
    return only(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", kept.alias("lines"))


def paragraphs(marked: DataFrame) -> DataFrame:
    """row, doc_id, place, line and grams of every paragraph with a marker."""
    return marked.select("row", "doc_id", F.inline("lines")).select("row", "doc_id", "place", "line", gram_column(F.col("line")).alias("grams"))


def train(found: DataFrame, negatives: int = NEGATIVES) -> LicenceModel:
    """Draws the bounded negatives from the paragraphs, in the order of a hash, and fits."""
    runs = sorted({g for notices in NOTICES.values() for n in notices for g in grams_of(n) if g.count(" ") == 2})
    rows = found.filter(~F.arrays_overlap("grams", F.array(*[F.lit(r) for r in runs])))
    rows = rows.filter(~F.lower("line").rlike("all rights reserved|public domain")).select("line")
    drawn = rows.groupBy("line").count().orderBy(F.xxhash64("line"), "line").limit(negatives).collect()
    return fit(sorted(r.line for r in drawn))


def licence_paragraphs(found: DataFrame, model: LicenceModel, confirm: float = CONFIRM) -> DataFrame:
    """row, doc_id, place, family, probability, overlap, confirmed of every paragraph that is a licence notice."""
    spark = found.sparkSession
    names = [f"w{k}" for k in range(NONE + 1)]
    known = _local(spark, [{"gram": g, **dict(zip(names, v, strict=True))} for g, v in model.weights.items()], "gram string, " + ", ".join(f"{n} double" for n in names))
    notices = _local(spark, [{"predicted": f, "template": sorted(grams_of(n))} for f, ns in NOTICES.items() for n in ns], "predicted string, template array<string>")
    hits = found.select("row", "doc_id", "place", "grams", F.explode("grams").alias("gram")).join(F.broadcast(known), "gram")
    sums = hits.groupBy("row", "doc_id", "place").agg(F.first("grams").alias("grams"), *[F.sum(n).alias(n) for n in names])
    # Softmax over an array; lambdas over arrays of one bind what is used more than once.
    def likeliest(z: Column) -> Column:
        shifted = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
        whole = F.aggregate(shifted, F.lit(0.0), lambda t, x: t + x)
        return F.array_max(F.transform(shifted, lambda x, k: F.struct((x / whole).alias("p"), (-k).alias("k"))))

    z = F.array(*[F.col(n) + F.lit(o) for n, o in zip(names, model.offsets, strict=True)])
    scored = sums.select("row", "doc_id", "place", "grams", F.element_at(F.transform(F.array(z), likeliest), 1).alias("best")).filter(F.col("best.k") > -NONE)
    named = scored.withColumn("predicted", F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), 1 - F.col("best.k"))).withColumn("probability", F.col("best.p"))
    compared = named.join(F.broadcast(notices), "predicted").withColumn("overlap", F.size(F.array_intersect("grams", "template")) / F.size(F.array_union("grams", "template")))
    out = compared.groupBy("row", "doc_id", "place", "predicted").agg(F.first("probability").alias("probability"), F.max("overlap").alias("overlap"))
    sure = (F.col("probability") >= model.threshold) & (F.col("overlap") >= confirm)
    return out.select("row", "doc_id", "place", F.when(sure, F.col("predicted")).otherwise("unknown").alias("family"), "probability", "overlap", sure.alias("confirmed"))


def scan_licences(docs: DataFrame, negatives: int = NEGATIVES) -> DataFrame:
    """One row per document row: doc_id, n_notices, families (sorted, comma-separated), family (of the likeliest confirmed notice, else unknown), probability."""
    scratch = Scratch(docs.sparkSession, "licences")
    marked = scratch.settle(marked_lines(docs), "marked")
    # Written once, the paragraphs are neither made again nor inlined into what follows.
    found = scratch.settle(paragraphs(marked), "paragraphs")
    best = F.max_by("family", F.struct(F.col("confirmed"), F.col("probability"), -F.col("place")))
    notices = licence_paragraphs(found.drop("line"), train(found, negatives))
    by_row = notices.groupBy("row").agg(F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), best.alias("family"), F.max("probability").alias("probability"))
    some = marked.filter("lines IS NOT NULL").select("row", "doc_id").join(by_row, "row", "left")
    whole = some.unionByName(marked.filter("lines IS NULL").select("row", "doc_id"), allowMissingColumns=True)
    return whole.select("doc_id", F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.coalesce("families", F.lit("")).alias("families"), "family", F.round("probability", 6).alias("probability"))
