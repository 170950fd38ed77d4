"""The licence scan: templates, planted lines and wrapped notices are confirmed."""

import re

import pytest

from llm_cases import frame
from skyroll.llm import licenses

SF = "/root/testdata/sf0.01"
WRAPPED = {
    "mit": """# Copyright (c) 2020 A. Person
#
# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell""",
    "apache-2.0": """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 */""",
    "gpl": """REM This program is free software: you can redistribute it and/or modify
REM it under the terms of the GNU General Public License as published by
REM the Free Software Foundation, either version 3 of the License, or""",
    "bsd": """Redistribution and use in source and binary
forms, with or without modification, are\r
permitted provided that the following\r
conditions are met:""",
}


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train_licenses(spark.read.parquet(f"{SF}/documents.parquet"))


def scan(spark, model, rows):
    return licenses.scan_licenses(frame(spark, rows), model).collect()


def test_templates_are_confirmed(spark, model):
    want = [(f, t) for f, texts in sorted(licenses.TEMPLATES.items()) for t in texts]
    rows = [(i, f"some words before it\n\n{t}\n\nand after") for i, (_, t) in enumerate(want)]
    got = {(r.doc_id, r.paragraph, r.family) for r in scan(spark, model, rows) if r.confirmed}
    assert got >= {(i, 2, f) for i, (f, _) in enumerate(want)}


def test_planted_lines_are_confirmed(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = {(r.doc_id, k) for r in docs.collect() for k, x in enumerate((r.text or "").split("\n"))
             if x.strip() == "All rights reserved."}
    got = {(r.doc_id, r.paragraph) for r in licenses.scan_licenses(docs, model).collect()
           if r.confirmed and r.lines == 1 and r.family == "all-rights-reserved"}
    assert lines and lines <= got


def test_wrapped_notices_are_confirmed(spark, model):
    want = list(WRAPPED.items())
    rows = [(i, f"title of it\n\n{t}\n\nlast words") for i, (_, t) in enumerate(want)]
    got = {(r.doc_id, r.family) for r in scan(spark, model, rows) if r.confirmed and r.lines > 1}
    assert got >= {(i, f) for i, (f, _) in enumerate(want)}


def test_paragraphs_are_lines_and_blocks(spark, none):
    text = "one two\n--\n\nthree\n * four five\nsix\n#\nseven"
    got = licenses.paragraphs(frame(spark, [(1, text), (2, None), (3, ""), (4, "\n \n")])).collect()
    assert sorted((r.paragraph, r.lines, r.words) for r in got) == [
        (0, 1, ["one", "two"]), (3, 1, ["three"]), (3, 3, ["three", "four", "five", "six"]),
        (4, 1, ["four", "five"]), (5, 1, ["six"]), (7, 1, ["seven"])]
    assert licenses.paragraphs(none).collect() == []


def test_every_paragraph_counts_in_fit_and_threshold(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    features = licenses.LicenseFeatures(spark, licenses.TEMPLATES)
    rows = features.of(licenses.paragraphs(docs)).cache()
    own, seen = licenses.saved, {}
    licenses.saved = lambda df, name: seen.setdefault(name, own(df, name))
    try:
        fitted = licenses.fit_licenses(features, rows)
    finally:
        licenses.saved = own
    plain = features.having(rows).where(~features.like_a_template()).count()
    unknown = seen["license-examples"].where("label = 0").agg({"weight": "sum"}).first()[0]
    scored = [(r.probability, r.n) for r in seen["license-scores"].collect()]
    assert plain > 400 and unknown == plain == sum(n for _, n in scored)
    assert sum(n for p, n in scored if p > fitted.threshold) <= licenses.FALSE_ALARMS * plain


def test_the_threshold_is_exact(spark):
    p = [0.1, 0.7, 0.7, 0.90001, 0.90002, 0.90003, 0.999999, 1.0]
    scored = spark.createDataFrame([(x, k + 1) for k, x in enumerate(p)], "probability double, n long")
    for share in (0, 0.1, 0.23, 0.42, 0.5, 0.75, 0.9, 1):
        got, many = licenses.least_threshold(scored, share), int(share * 36)
        want = min(t for t in [licenses.LEAST_PROBABILITY, *p[1:]]
                   if sum(k + 1 for k, x in enumerate(p) if x > t) <= many)
        assert got == pytest.approx(want, abs=1e-8)
        assert sum(k + 1 for k, x in enumerate(p) if x > got) <= many


def test_like_a_template_is_as_counted_on_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    features = licenses.LicenseFeatures(spark, licenses.TEMPLATES)
    lines = [licenses.paragraphs(docs), features.positive.select(
        licenses.F.lit(-1).cast("long").alias("doc_id"), licenses.F.lit(0).alias("paragraph"),
        licenses.F.lit(1).alias("lines"), "words")]
    words = lines[0].unionByName(lines[1])
    rows = features.of(words.withColumn("kept", licenses.F.col("words")))
    got = features.having(rows).select("kept", features.like_a_template().alias("like")).collect()

    def grams(w):
        return set(zip(w, w[1:])) if len(w) > 1 else set(w)
    known = [grams(re.findall("[a-z0-9]+", t.lower())) for ts in licenses.TEMPLATES.values() for t in ts]
    want = [any(len(grams(r.kept) & g) >= 0.6 * len(g) or grams(r.kept) <= g for g in known)
            for r in got]
    assert [r.like for r in got] == want and any(want) and not all(want)
