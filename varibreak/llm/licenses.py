"""Licence scan: a trained paragraph classifier, confirmed against templates.

Every paragraph (line) of every document is classified by a multinomial logistic regression over hashed word
n-grams (one and two words) into licence families or ``unknown``.  Training rows are phrasings of the families,
whole, with words dropped from either end and with foreign words around them, and ordinary paragraphs of the
corpus as the unknown class, ``ORDINARY`` at most, chosen by hash.  A third of the rows is held out: a temperature
is fitted on it, and the least probability a family needs is set so that of the held-out ordinary paragraphs one
in ``ADMITTED`` passes at most.
A prediction counts only when the family's template agrees: at least ``NEAR`` of the template's word pairs stand
in the paragraph.  Others are reported as unconfirmed.

Everything is made of built-in functions and Spark's own estimator.  Defined cases: NULL and empty texts have no
paragraphs to report; repeated rows are reported each; an empty corpus gives no rows.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage

# Usual short notices of well-known licences, by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part may be reproduced without permission.",
    ],
}
UNKNOWN = "unknown"
ORDINARY = 4000
DIMENSIONS = 1 << 12
NEAR = 0.8
HELD_OUT = 3
ADMITTED = 200
FLOOR = 0.5


def paragraph_words(paragraph: Column) -> Column:
    """Lower-case runs of letters, digits, dots and dashes inside words."""
    plain = F.regexp_replace(F.lower(paragraph), r"[^\p{L}\p{N}.-]+|[.-]+(?=\s|$)", " ")
    return F.split(F.btrim(plain), " +")


def grams(words: Column) -> Column:
    """The words and their neighbouring pairs."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def _pairs(words: Column) -> Column:
    return F.array_distinct(F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b)))


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph, text, words``: the non-blank lines of every document.

    The words come out of the generator with the line: a filter on the prediction moves below projections and would
    take a line apart once for every mention of its words, but it does not move below a generator.
    """
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    parts = F.transform(lines, lambda line: F.struct(line.alias("text"), paragraph_words(line).alias("words")))
    rows = docs.select("doc_id", F.posexplode(parts).alias("paragraph", "part"))
    return rows.select("doc_id", "paragraph", "part.text", "part.words").filter(F.trim("text") != "")


def training_rows(spark: SparkSession, ordinary: DataFrame) -> DataFrame:
    """``text, family, held_out`` from the templates and the ordinary paragraphs."""
    notices = spark.createDataFrame([(f, t) for f, texts in TEMPLATES.items() for t in texts], "family string, notice string")
    own = F.split("notice", " +")
    n = F.size(own)
    room = F.least(F.lit(3), F.floor(n / 4).cast("int"))
    cuts = notices.select("family", own.alias("w"), F.explode(F.sequence(F.lit(0), room)).alias("front"))
    cuts = cuts.withColumn("back", F.explode(F.sequence(F.lit(0), F.least(F.lit(3), F.floor(F.size("w") / 4).cast("int")))))
    whole = cuts.filter("front + back < size(w) - 1").select(
        "family", F.array_join(F.slice("w", F.col("front") + 1, F.size("w") - F.col("front") - F.col("back")), " ").alias("text"))
    heads = ordinary.select(F.split("text", " +").alias("own"), F.row_number().over(_by_hash()).alias("k"))
    heads = heads.select("k", F.explode(F.array(F.lit(4), F.lit(14))).alias("n"), "own").select("k", F.array_join(F.slice("own", 1, F.col("n")), " ").alias("other"))
    around = whole.withColumn("k", F.pmod(F.xxhash64("text"), F.lit(97)).cast("int") + 1).join(heads.filter("k <= 97"), "k")
    around = around.select("family", F.concat_ws(" ", "other", "text", "other").alias("text"))
    rows = whole.unionByName(around).unionByName(ordinary.select(F.lit(UNKNOWN).alias("family"), "text"))
    return rows.withColumn("held_out", F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0)


def _by_hash():
    return Window.orderBy(F.xxhash64("text"), "text")  # over the bounded sample only


class LicenceModel:
    """The fitted regression with its temperature and threshold."""

    def __init__(self, docs: DataFrame, ordinary: int = ORDINARY):
        spark = docs.sparkSession
        cues = F.arrays_overlap(paragraph_words(F.col("text")), F.array(*[F.lit(w) for w in ("license", "licensed", "licence", "copyright", "reserved", "spdx-license-identifier")]))
        lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("text")).filter(F.trim("text") != "")
        sample = lines.filter(~cues).select("text").orderBy(F.xxhash64("text"), "text").limit(ordinary)
        rows = cut_lineage(training_rows(spark, cut_lineage(sample)))
        self.families = [UNKNOWN, *sorted(TEMPLATES)]
        label = F.array_position(F.array(*[F.lit(f) for f in self.families]), F.col("family")).cast("double") - 1
        self.hashing = HashingTF(numFeatures=DIMENSIONS, binary=True, inputCol="grams", outputCol="features")
        table = self.hashing.transform(rows.withColumn("grams", grams(paragraph_words(F.col("text")))).withColumn("label", label))
        # every phrasing is learnt; ordinary paragraphs of the held-out part are not
        learnt = table.filter((~F.col("held_out")) | (F.col("family") != UNKNOWN))
        self.model = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=30).fit(learnt.coalesce(2))
        held = self.model.transform(table.filter("held_out")).select("label", vector_to_array("rawPrediction").alias("raw")).collect()
        self.temperature = self._fit_temperature(held)
        passing = sorted(max(self._softmax(r.raw)[1:]) for r in held if r.label == 0)
        self.threshold = max([FLOOR, *passing[:len(passing) - len(passing) // ADMITTED]])

    def _softmax(self, raw, temperature: float | None = None) -> list[float]:
        t = temperature or self.temperature
        top = max(raw)
        e = [math.exp((v - top) / t) for v in raw]
        return [v / sum(e) for v in e]

    def _fit_temperature(self, held) -> float:
        grid = [0.5 * 1.15**i for i in range(20)]
        loss = lambda t: -sum(math.log(max(self._softmax(r.raw, t)[int(r.label)], 1e-12)) for r in held)
        return min(grid, key=loss)

    def classify(self, rows: DataFrame) -> DataFrame:
        """Add ``family`` and ``probability`` to rows with ``words``; paragraphs below the threshold are unknown."""
        scored = self.model.transform(self.hashing.transform(rows.withColumn("grams", grams(F.col("words")))))
        scored = scored.filter(F.col("prediction") > 0).withColumn("raw", vector_to_array("rawPrediction"))
        top = F.array_max("raw")
        total = F.aggregate("raw", F.lit(0.0), lambda acc, v: acc + F.exp((v - F.array_max("raw")) / self.temperature))
        best = F.element_at(F.array(*[F.lit(f) for f in self.families]), F.array_position("raw", top).cast("int"))
        probability = F.lit(1.0) / total
        return scored.withColumn("probability", probability).filter(F.col("probability") > self.threshold).withColumn("family", best)


def scan_licences(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph, family, probability, similarity, confirmed, text`` of every paragraph given a licence family."""
    found = LicenceModel(docs).classify(paragraphs(docs))
    spark = docs.sparkSession
    notices = spark.createDataFrame([(f, t) for f, texts in TEMPLATES.items() for t in texts], "family string, notice string")
    notices = notices.select("family", _pairs(paragraph_words(F.col("notice"))).alias("template")).groupBy("family").agg(F.collect_list("template").alias("templates"))
    own = _pairs(F.col("words"))
    shared = lambda t: F.size(F.array_intersect(t, F.col("own"))) / F.size(t)
    found = found.withColumn("own", own).join(F.broadcast(notices), "family")  # one row per family
    found = found.withColumn("similarity", F.array_max(F.transform("templates", shared)))
    return found.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), "similarity",
                        (F.col("similarity") >= NEAR).alias("confirmed"), "text")
