"""Licence scan: which licence families the paragraphs of a text grant.

A paragraph ends at a blank line. Its words, wherever its lines are wrapped, are cut
into overlapping windows that are longer than any notice, and every window is scored:
a sparse multinomial logistic regression over the n-grams of the notices names the
family or the class ``unknown``. The probability that a family needs is calibrated on
windows of the corpus that the fit did not see. A prediction counts once a template of
that family confirms it by the share of its n-grams that the window holds.
Weights and templates become column expressions, so scoring runs without Python.

The model learns from notices (below), alone, with words dropped, and among n-grams as
frequent as they are in the corpus, and from every window of the corpus as the unknown
class: windows that hold the same n-grams are one row with their number.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, documents, written

UNKNOWN = "unknown"
#: Short notices by family (fixed values: the wording in use).
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "Apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Released under the Apache License 2.0.", "Apache License Version 2.0, January 2004"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GNU GPL version 2 or later.", "Released under the GNU General Public License."],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Released under the BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright under the CC0 1.0 Universal Public Domain Dedication license."],
    "proprietary": ["Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission.", "All rights reserved; reproduction without written permission is prohibited.", "All rights reserved."],
}
#: Prose with the same words that grants nothing.
LOOKALIKES = [
    "You need a driving license to rent a car in the city.",
    "She renewed her fishing licence at the general store.",
    "The public library asked for permission to use the school hall.",
    "The software was released last year and is used in many schools.",
    "The general public was not permitted to enter the source building.",
    "A licensed electrician must sign the form before work begins.",
    "Please ask for permission before you copy this recipe.",
    "The copyright lawsuit was settled under terms that stay private.",
    "The Apache helicopter landed near the public road.",
    "Students of the MIT course met under the bridge.",
    "Version 3 of the plan was published under the title Free Work.",
    "The license plate was found in the domain of the old mill.",
]
#: Licence identifiers by family (fixed values).
IDENTIFIERS = {
    "Apache": ["Apache-2.0"], "GPL": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"], "LGPL": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later"],
    "AGPL": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "BSD": ["BSD-2-Clause", "BSD-3-Clause"], "MPL": ["MPL-2.0"], "CC-BY": ["CC-BY-4.0", "CC BY 4.0"], "CC-BY-SA": ["CC-BY-SA-4.0", "CC BY-SA 4.0"],
    "CC-BY-NC": ["CC-BY-NC-4.0", "CC BY-NC 4.0"], "CC0": ["CC0-1.0", "CC0 1.0"], "MIT": ["SPDX-License-Identifier: MIT"],
}
#: Words of a window, and how many of them the next window does not share: notices have fewer than WORDS - STEP.
WORDS, STEP = 64, 24
#: A run of letters, digits, dots and hyphens inside words.
TOKEN = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
PENALTY = 0.0005
#: Parts of the table of n-grams: Spark looks through the keys of a map one by one.
PARTS = 256
#: Share of a template's n-grams that confirms a prediction, rounds of altered notices.
CONFIRM, ROUNDS = 0.7, 12
#: Weight of a window of the corpus in the fit, and of all of them at most: they must not drown the notices.
WINDOW_WEIGHT, CORPUS_WEIGHT = 0.2, 500.0
#: Share of the corpus's held windows without a notice that may reach the probability asked for.
FALSE_RATE = 0.002
LEAST_PROBABILITY = 0.5
#: Steps of the log-odds by which held windows are counted, to a unit, and the log-odds where a double's probability is 1.
STEPS, MOST_ODDS = 1_000, 37


def _parts(notice: str) -> list[str]:
    """The different word pairs of a notice, or its word if it has one."""
    words = re.findall(TOKEN, notice.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:]))) or words


#: (family, n-grams) of every notice and identifier, and all their n-grams.
TEMPLATES = [(f, _parts(n)) for by in (NOTICES, IDENTIFIERS) for f, notices in by.items() for n in notices]
GRAMS = sorted({g for _, parts in TEMPLATES for g in parts})
_PLACE = {g: k for k, g in enumerate(GRAMS)}


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)


def _marks(words: Column) -> Column:
    """struct(word, pair): for each word its place among GRAMS, and that of the pair that it begins; null where it has none."""
    parts: list[list[str]] = [[] for _ in range(PARTS)]
    for g in GRAMS:
        parts[zlib.crc32(g.encode()) % PARTS].append(g)
    table = F.array(*[F.map_from_arrays(F.array(*[F.lit(g) for g in own]).cast("array<string>"), F.array(*[F.lit(_PLACE[g]) for g in own]).cast("array<int>")) for own in parts])
    alone, pairs = [g for g in GRAMS if " " not in g], [g for g in GRAMS if " " in g]
    begin = sorted({g.split(" ")[0] for g in pairs})

    def place(g: Column, known: list[str]) -> Column:
        return F.when(g.isin(known), table[(F.crc32(g.cast("binary")) % PARTS).cast("int")][g])

    def pair(word: Column, i: Column) -> Column:
        return F.when(word.isin(begin), place(F.concat(word, F.lit(" "), F.get(words, i + 1)), pairs))

    return F.struct(F.transform(words, lambda w: place(w, alone)).alias("word"), F.transform(words, pair).alias("pair"))


def _hits(marks: Column, n: int | None = None, i: Column | None = None) -> Column:
    """The places in order, once each, of the words and pairs of ``n`` words from ``i``, or of all."""
    words, pairs = marks["word"], marks["pair"]
    if n is not None:
        words, pairs = F.slice(words, i, F.lit(n)), F.slice(pairs, i, F.lit(n - 1))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(words, pairs))))


def _paragraphs(text: Column) -> Column:
    return F.split(text, r"\n[\x20\t\r]*\n")


def _starts(words: Column) -> Column:
    """Where the windows of a paragraph begin, from 1."""
    return F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - (WORDS - STEP), F.lit(1)), F.lit(STEP)), lambda i: F.size(words) > 0)


def windows(text: Column) -> Column:
    """Arrays of words: the windows of each paragraph. Blank texts have none."""

    def of(paragraph: Column) -> Column:
        return _once(tokens(paragraph), lambda t: F.transform(_starts(t), lambda i: F.slice(t, i, F.lit(WORDS))))

    return F.flatten(F.transform(_paragraphs(text), of))


def _of_windows(paragraph: Column, then: Callable[[Column, Column, Column], Column]) -> Column:
    """``then`` of the words and marks of a paragraph, which are made once for all windows that share them, and of each window's start."""
    return _once(tokens(paragraph), lambda t: _once(_marks(t), lambda m: F.transform(_starts(t), lambda i: then(t, m, i))))


@dataclass(frozen=True)
class LicenceModel:
    """Classes, intercepts, the weights of each of GRAMS by class, and the least probability of a family."""

    classes: tuple[str, ...]
    intercepts: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]
    least: float

    def verdict(self, hits: Column) -> Column:
        """struct(family, probability) of the likeliest class by the places of the n-grams, once each; null without any."""
        start = F.array(*[F.lit(v) for v in self.intercepts])
        rows = F.array(*[F.array(*[F.lit(v) for v in w]) for w in self.weights])
        margins = F.aggregate(hits, start, lambda acc, k: F.zip_with(acc, rows[k], lambda a, b: a + b))
        names = F.array(*[F.lit(c) for c in self.classes])

        def likeliest(e: Column) -> Column:
            probability = 1.0 / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
            return F.struct(names[F.array_position(e, F.array_max(e)).cast("int") - 1].alias("family"), probability.alias("probability"))

        def scaled(m: Column) -> Column:
            return _once(F.array_max(m), lambda most: F.transform(m, lambda v: F.exp(v - most)))

        return F.when(F.size(hits) > 0, _once(margins, lambda m: _once(scaled(m), likeliest)))


def _confirming(hits: Column) -> Column:
    """The families of the templates that have enough of their n-grams among these places."""
    templates = F.array(*[F.struct(F.lit(f).alias("family"), F.array(*[F.lit(_PLACE[g]) for g in parts]).alias("parts")) for f, parts in TEMPLATES])
    held = F.filter(templates, lambda t: F.size(F.array_intersect(t["parts"], hits)) >= CONFIRM * F.size(t["parts"]))
    return F.array_distinct(F.transform(held, lambda t: t["family"]))


def _examples(spark: SparkSession, shares: list[float]) -> DataFrame:
    """(family, hits, weight): notices and look-alikes alone, with a word in so many dropped, and among n-grams met with the ``shares`` of GRAMS."""
    notices = [(f, n) for by in (NOTICES, IDENTIFIERS) for f, own in by.items() for n in own]
    given = spark.createDataFrame([*notices, *[(UNKNOWN, x) for x in LOOKALIKES]], "family string, text string").withColumn("words", tokens(F.col("text")))
    rounds = given.crossJoin(F.broadcast(spark.range(ROUNDS).withColumnRenamed("id", "round")))  # a dozen copies of a few dozen rows
    altered = F.filter("words", lambda w: (F.col("round") < 3) | (F.size("words") < 4) | (F.pmod(F.xxhash64(w, F.col("round")), F.lit(8)) > 0))
    own = _once(_marks(altered), lambda m: _hits(m))
    share = F.array(*[F.lit(float(s)) for s in shares])
    met = F.filter(F.sequence(F.lit(0), F.lit(len(GRAMS) - 1)), lambda k: F.pmod(F.xxhash64(k, "text", "round"), F.lit(1_000_000)) < share[k] * 1_000_000)
    among = F.when(F.pmod("round", F.lit(2)) == 1, F.array_sort(F.array_union(own, met))).otherwise(own)
    return rounds.select("family", among.alias("hits"), F.lit(1.0).alias("weight"))


def learn(docs: DataFrame, text_col: str = "text") -> LicenceModel:
    """Fits the n-gram weights on two thirds of the different windows of all texts and calibrates the unknown class on the last third.

    Every window takes part, unless a template confirms it; equal windows (by 64-bit hash) count once. A window tells the
    model its n-grams alone, so those with the same n-grams are one row with their number. The probability asked for is
    the least that FALSE_RATE of the held windows or fewer reach, to a STEPS-th of its log-odds, and LEAST_PROBABILITY at least.
    """
    spark = docs.sparkSession
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))

    def of_window(words: Column, marks: Column, i: Column) -> Column:
        return F.struct(F.xxhash64(F.slice(words, i, F.lit(WORDS))).alias("by"), _hits(marks, WORDS, i).alias("hits"))

    found = F.flatten(F.transform(_paragraphs(text), lambda p: _of_windows(p, of_window)))
    different = docs.select(F.explode(found).alias("w")).select("w.by", "w.hits").distinct()
    counted = different.groupBy("hits", (F.pmod("by", F.lit(3)) == 0).alias("held")).agg(F.count(F.lit(1)).alias("n"))
    counted = written(counted.where(F.size(_confirming(F.col("hits"))) == 0), "windows")
    total = {r.held: r.n for r in counted.groupBy("held").agg(F.sum("n").alias("n")).collect()}
    fit, held = counted.where("NOT held"), counted.where("held")
    met = {r.k: r.n for r in fit.select(F.explode("hits").alias("k"), "n").groupBy("k").agg(F.sum("n").alias("n")).collect()}  # one row of GRAMS each
    n = total.get(False, 0)
    unknown = fit.select(F.lit(UNKNOWN).alias("family"), "hits", (F.col("n") * min(WINDOW_WEIGHT, CORPUS_WEIGHT / max(n, 1))).alias("weight"))
    classes = [*NOTICES, UNKNOWN]
    label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")).cast("double") - 1
    names = F.array(*[F.lit(g) for g in GRAMS])
    rows = _examples(spark, [met.get(k, 0) / max(n, 1) for k in range(len(GRAMS))]).unionByName(unknown)
    rows = written(rows.select(F.transform("hits", lambda k: names[k]).alias("grams"), label.alias("label"), "weight"), "examples")
    features = CountVectorizerModel.from_vocabulary(GRAMS, inputCol="grams", outputCol="features").setBinary(True)
    fitted = LogisticRegression(family="multinomial", regParam=PENALTY, elasticNetParam=1.0, maxIter=60, weightCol="weight", standardization=False).fit(features.transform(rows))
    weights = tuple(tuple(map(float, w)) for w in fitted.coefficientMatrix.toArray().T)
    model = LicenceModel(tuple(classes), tuple(map(float, fitted.interceptVector.toArray())), weights, LEAST_PROBABILITY)
    verdicts = held.select(model.verdict(F.col("hits")).alias("v"), "n").where((F.col("v.family") != UNKNOWN) & (F.col("v.probability") >= LEAST_PROBABILITY))
    odds = F.when(F.col("v.probability") < 1, F.log(F.col("v.probability") / (1 - F.col("v.probability"))))
    step = F.floor(F.least(F.coalesce(odds, F.lit(float(MOST_ODDS))), F.lit(float(MOST_ODDS))) * STEPS)
    steps = verdicts.groupBy(step.alias("step")).agg(F.sum("n").alias("n"))  # STEPS * MOST_ODDS + 1 rows at most
    reached = F.sum("n").over(Window.orderBy(F.desc("step")))
    worst = steps.select("step", reached.alias("reached")).where(F.col("reached") > FALSE_RATE * total.get(True, 0)).agg(F.max("step")).first()[0]
    least = LEAST_PROBABILITY if worst is None else math.nextafter(1 / (1 + math.exp(-(worst + 1) / STEPS)), 2.0)
    return LicenceModel(model.classes, model.intercepts, model.weights, least)


def scan(df: DataFrame, model: LicenceModel, text_col: str = "text") -> DataFrame:
    """Every row of ``df`` with ``licences`` and ``n_notices`` added; columns of those names are replaced.

    licences lists the confirmed families in order, n_notices counts the families
    that each paragraph (up to a blank line) grants. Null, empty and blank texts have
    none; equal texts get equal results; an empty table gives an empty result.
    """
    df = df.drop("licences", "n_notices")
    names = df.columns
    kept = F.struct(*[column(df, c).alias(f"c{i}") for i, c in enumerate(names)])
    text = F.coalesce(column(df, text_col).cast("string"), F.lit(""))

    def granted(paragraph: Column) -> Column:
        """The families of a paragraph."""
        hits = F.filter(F.array_distinct(_of_windows(paragraph, lambda words, marks, i: _hits(marks, WORDS, i))), lambda h: F.size(h) > 0)
        scored = F.transform(hits, lambda h: F.struct(h.alias("hits"), model.verdict(h).alias("v")))
        sure = F.filter(scored, lambda x: (x["v"]["family"] != UNKNOWN) & (x["v"]["probability"] >= model.least))
        confirmed = F.filter(sure, lambda x: F.array_contains(_confirming(x["hits"]), x["v"]["family"]))
        return F.array_distinct(F.transform(confirmed, lambda x: x["v"]["family"]))

    out = df.select(kept.alias("row"), F.flatten(F.transform(_paragraphs(text), granted)).alias("found"))
    return out.select(
        *[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(names)],
        F.array_sort(F.array_distinct("found")).alias("licences"),
        F.size("found").cast("long").alias("n_notices"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = scan(docs, learn(docs))
    return out.select("doc_id", F.array_join("licences", ",").alias("licences"), "n_notices")
