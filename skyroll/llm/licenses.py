"""Licence scans: a trained paragraph classifier (DataFrame, SQL and Spark ML).

Paragraphs are single lines and, beside them, blocks of two or more lines
between lines without words (a wrapped notice, comment marks stripped). Both
are classified by sparse multinomial logistic regression on
word one- and two-grams into licence families and an unknown class. Positive
examples are the families' template paragraphs and pieces of them; unknown ones
are all paragraphs of the corpus that are not like a template, so ordinary prose is
what the model knows best as unknown. The probability a family needs is
calibrated on all of these: at most ``FALSE_ALARMS`` of them may exceed it. A
prediction is confirmed by comparing the paragraph with the
family's templates: most of a template's two-grams must be in it.

Only n-grams of the templates are features, so the model's size is fixed by
them. One pass over every whole text writes the features of every paragraph;
equal ones are counted, so the fit and the calibration work on distinct features
weighted by their counts. Scoring is map-only and covers every paragraph.

Defined cases: null and empty texts and blank lines give no rows; a paragraph's
number is that of its first line, and ``lines`` tells a block (2 and more) from
the lines in it, which give rows of their own; only
paragraphs predicted as a family give rows, unconfirmed ones included; repeated
rows give a row each; an empty corpus gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyroll.llm.common import documents, saved

UNKNOWN = "unknown"
FALSE_ALARMS = 0.0005    # of the unknown paragraphs may exceed the threshold
THRESHOLD_STEPS = 1000   # of a range of probabilities, each round of the calibration
THRESHOLD_ROUNDS = 3
LEAST_PROBABILITY = 0.6
CONFIRM_SHARE = 0.6      # of a template's two-grams
COMMENT_WORD = r"(?i)^\s*(rem|dnl)(?=\s)"  # comment marks made of letters

# Notices by which the families are commonly declared.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT"],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-only"],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0"],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights "
        "to this work under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0"],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright by the author. All rights reserved.",
        "All rights reserved. No part of this work may be reproduced without written permission."],
}


def words_of(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def two_grams(words: Column) -> Column:
    return F.when(F.size(words) < 2, words).otherwise(F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b)))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (its first line, from 0), lines and words, for lines
    that have any words and for blocks of such lines."""
    line = F.transform(F.split("text", "\n"), lambda x: words_of(
        F.regexp_replace(x, COMMENT_WORD, "")))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", line.alias("line"))
    # Line numbers with words; a block begins and ends where numbers leave a gap.
    numbered = texts.select("doc_id", "line", F.filter(
        F.sequence(F.lit(0), F.size("line") - 1),
        lambda i: F.size(F.get("line", i)) > 0).alias("at"))
    n = F.size("at")
    first = F.filter("at", lambda x, k: (k == 0) | (F.get("at", k - 1) != x - 1))
    last = F.filter("at", lambda x, k: (k == n - 1) | (F.get("at", k + 1) != x + 1))
    bounds = numbered.select("doc_id", "line", "at", F.filter(
        F.zip_with(first, last, lambda a, z: F.struct(a.alias("a"), (z - a + 1).alias("n"))),
        lambda b: b["n"] > 1).alias("block"))
    both = F.concat(
        F.transform("at", lambda i: F.struct(
            i.alias("paragraph"), F.lit(1).alias("lines"), F.get("line", i).alias("words"))),
        F.transform("block", lambda b: F.struct(
            b["a"].alias("paragraph"), b["n"].alias("lines"),
            F.flatten(F.slice("line", b["a"] + 1, b["n"])).alias("words"))))
    return bounds.select("doc_id", F.inline(both))


def with_grams(rows: DataFrame) -> DataFrame:
    return rows.withColumn("grams", F.concat("words", two_grams(F.col("words"))))


def _constant_rows(spark: SparkSession, templates: dict) -> DataFrame:
    """family, template text: a constant relation built by expressions."""
    rows = [F.struct(F.lit(family).alias("family"), F.lit(t).alias("template"))
            for family, texts in sorted(templates.items()) for t in texts]
    return spark.range(1).select(F.inline(F.array(*rows)))


def training_examples(known: DataFrame) -> DataFrame:
    """family, words: each template, its halves and thirds, and it without its
    first or last words; pieces of fewer than three words are too short to tell."""
    base = known.select("family", words_of(F.col("template")).alias("w"))
    n = F.size("w")
    pieces = F.array(
        F.col("w"),
        F.slice("w", F.lit(1), F.greatest(F.ceil(n * 2 / 3), F.lit(1)).cast("int")),
        F.slice("w", (F.floor(n / 3) + 1).cast("int"), n),
        F.slice("w", F.lit(2), n),
        F.slice("w", F.lit(1), F.greatest(n - 1, F.lit(1))))
    return (base.select("family", F.explode(pieces).alias("words"))
            .where(F.size("words") >= 3).distinct())


class LicenseModel:
    def __init__(self, features, regression, threshold):
        self.features, self.regression, self.threshold = features, regression, threshold

    def scores(self, rows: DataFrame) -> DataFrame:
        """``rows`` (of ``LicenseFeatures``) with the best family and its probability."""
        families = self.features.families
        p = vector_to_array("probability")
        known = F.slice(p, 2, len(families))
        best = F.array_max(known)
        names = F.array(*[F.lit(f) for f in families])
        return self.regression.transform(rows).select(
            *rows.columns, best.alias("probability"), F.element_at(
                names, F.array_position(known, best).cast("int")).alias("family"))


class LicenseFeatures:
    """Which n-grams of the templates a paragraph has."""

    def __init__(self, spark: SparkSession, templates: dict):
        self.families = sorted(templates)
        known = _constant_rows(spark, templates)
        self.positive = training_examples(known)
        words = known.select("family", words_of(F.col("template")).alias("words"))
        vocabulary = [r["g"] for r in
                      with_grams(self.positive).select(F.explode("grams").alias("g"))
                      .union(with_grams(words).select(F.explode("grams").alias("g")))
                      .distinct().orderBy("g").collect()]  # fixed by the templates
        place = {g: k for k, g in enumerate(vocabulary)}
        # (family, places of its two-grams) of every template
        self.templates = [(r["family"], sorted({place[g] for g in r["g"]})) for r in
                          words.select("family", two_grams(F.col("words")).alias("g")).collect()]
        self.two_grams = sorted({k for _, own in self.templates for k in own})
        # beyond the two-grams of the longest template their number tells nothing
        self.most = max(len(own) for _, own in self.templates) + 1
        self.vectorizer = CountVectorizerModel.from_vocabulary(
            vocabulary, inputCol="grams", outputCol="features")
        self.vectorizer.setBinary(True)

    def of(self, words: DataFrame) -> DataFrame:
        """``words`` replaced by ``features`` and ``grams``, the number of distinct
        two-grams (up to ``most``)."""
        kept = [c for c in words.columns if c != "words"]
        n = F.least(F.size(F.array_distinct(two_grams(F.col("words")))), F.lit(self.most))
        found = self.vectorizer.transform(with_grams(words.withColumn("n_grams", n)))
        return found.select(*kept, "features", F.col("n_grams").alias("grams"))

    @staticmethod
    def having(rows: DataFrame) -> DataFrame:
        """``rows`` with ``have``, the places of their n-grams."""
        return rows.withColumn("have", F.array_compact(F.transform(
            vector_to_array("features"), lambda x, k: F.when(x > 0, k))))

    @staticmethod
    def hits(places: list[int]) -> Column:
        """How many of the n-grams at ``places`` a paragraph has."""
        return F.size(F.array_intersect("have", F.array(*[F.lit(k) for k in places])))

    def like_a_template(self) -> Column:
        """Has most two-grams of a template, or none but a template's."""
        like = [(self.hits(own) >= CONFIRM_SHARE * len(own)) | (self.hits(own) == F.col("grams"))
                for _, own in self.templates]
        least = CONFIRM_SHARE * min(len(own) for _, own in self.templates)
        any_own = self.hits(self.two_grams)      # too few for most paragraphs
        return ((any_own >= least) | (any_own == F.col("grams"))) & reduce(lambda a, b: a | b, like)

    def similarity(self) -> Column:
        """The greatest share of a template of ``family`` that a paragraph has."""
        by_family = None
        for family in self.families:
            shares = [self.hits(own) / len(own) for f, own in self.templates if f == family]
            case = (F.col("family") == family, F.greatest(*shares, F.lit(0.0)))
            by_family = F.when(*case) if by_family is None else by_family.when(*case)
        return by_family


def least_threshold(scored: DataFrame, share: float = FALSE_ALARMS) -> float:
    """The smallest probability from ``LEAST_PROBABILITY`` on that at most ``share`` of the
    ``n`` paragraphs behind each row of ``scored`` exceed, to a billionth part: each round
    counts ``THRESHOLD_STEPS`` steps of a range and goes on within the step that is one too
    many."""
    allowed = int(share * (scored.agg(F.sum("n")).first()[0] or 0))
    low, high, above = LEAST_PROBABILITY, 1.0, 0
    for _ in range(THRESHOLD_ROUNDS):
        width = (high - low) / THRESHOLD_STEPS
        step = F.ceil((F.col("probability") - low) / width) - 1
        step = F.greatest(F.lit(0), F.least(F.lit(THRESHOLD_STEPS - 1), step))
        counts = {r["step"]: r["n"] for r in
                  scored.where((F.col("probability") > low) & (F.col("probability") <= high))
                  .groupBy(step.alias("step")).agg(F.sum("n").alias("n")).collect()}
        for k in range(THRESHOLD_STEPS - 1, -1, -1):
            if above + counts.get(k, 0) > allowed:
                low, high = low + k * width, low + (k + 1) * width
                break
            above += counts.get(k, 0)
        else:
            return low
    return min(high, 1.0)


def fit_licenses(features: LicenseFeatures, rows: DataFrame) -> LicenseModel:
    """``rows``: the features of all paragraphs of the corpus, saved."""
    # The corpus's own licence paragraphs are no examples of the unknown class,
    # and neither are lines that a template contains.
    # Written down, or the filter would be applied to every paragraph.
    alike = saved(features.having(rows.groupBy("features", "grams").agg(
        F.count(F.lit(1)).alias("n"))), "license-alike")
    plain = saved(alike.where(~features.like_a_template())
                  .groupBy("features").agg(F.sum("n").alias("n")), "license-plain")
    unknown = plain.agg(F.sum("n")).first()[0] or 0
    index = F.array_position(F.array(*[F.lit(f) for f in features.families]), F.col("family"))
    known = features.of(features.positive).select("features", index.cast("double").alias("label"))
    counts = {r["label"]: r["n"] for r in
              known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = F.lit(1.0)
    for label, n in counts.items():
        weight = F.when(F.col("label") == label, F.lit(max(1.0, unknown / 20.0 / n))).otherwise(weight)
    ready = saved(known.withColumn("weight", weight).unionByName(plain.select(
        "features", F.lit(0.0).alias("label"), F.col("n").cast("double").alias("weight"))),
        "license-examples")
    regression = LogisticRegression(
        family="multinomial", weightCol="weight", maxIter=80, regParam=0.0005,
        elasticNetParam=0.5, standardization=False).fit(ready)
    model = LicenseModel(features, regression, LEAST_PROBABILITY)
    model.threshold = least_threshold(saved(
        model.scores(plain).select("probability", "n"), "license-scores"))
    return model


def train_licenses(docs: DataFrame, templates: dict = TEMPLATES) -> LicenseModel:
    features = LicenseFeatures(docs.sparkSession, templates)
    return fit_licenses(features, saved(features.of(paragraphs(docs)), "license-paragraphs"))


def found_licenses(rows: DataFrame, model: LicenseModel) -> DataFrame:
    found = model.scores(rows).where(F.col("probability") > model.threshold)
    return model.features.having(found).withColumn(
        "similarity", model.features.similarity()).select(
        "doc_id", "paragraph", "family", "probability", "similarity",
        (F.col("similarity") >= CONFIRM_SHARE).alias("confirmed"), "lines")


def scan_licenses(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, confirmed, lines."""
    return found_licenses(model.features.of(paragraphs(docs)), model)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = LicenseFeatures(spark, TEMPLATES)
    rows = saved(features.of(paragraphs(documents(spark, sf_dir))), "license-paragraphs")
    return found_licenses(rows, fit_licenses(features, rows))
