"""Licence notices by a trained paragraph classifier, DataFrame functions only.

A paragraph is a line of a text, or a run of lines without an empty one between them, as
wide as the longest template, so that wrapped notices are met whole; a licence expression
with OR or AND is one paragraph for each of its licences. What a text says it is not
licensed under is cut out. Features are the word runs of up to three words that occur in
a licence template and are not made of common words alone. A multinomial logistic
regression over them is trained in Spark on the templates, on parts of them, on sentences
that merely mention licences, and on a bounded sample of the corpus' own paragraphs, which
stand for ``unknown``. A prediction is confirmed if, of all templates, one of its family
is the one that the paragraph holds most of, and enough of. The probability from which a
prediction counts is calibrated on all paragraphs that no template confirms.

Features hold at least one telling word, and a confirmed paragraph a least number of
them, so other paragraphs are unknown as they stand; the telling words and the weights
are bounded by the templates, not by the data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphsweep.llm.common import staged, text_or_empty
from glyphsweep.llm.decontam import words
from glyphsweep.llm.learning import bounded_sample

UNKNOWN = "unknown"
LONGEST = 3
#: Corpus paragraphs that stand for unknown, at most.
MOST_UNKNOWN = 2_000
#: What a corpus paragraph counts beside a template.
CORPUS_WEIGHT = 0.02
#: Share of a template's features that must occur, and of corpus paragraphs that may
#: pass the calibrated probability.
CONFIRMED, PASSING = 0.6, 0.001

#: Notices in common use, by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "GPL-2.0": [
        "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-3.0-only", "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License.", "SPDX-License-Identifier: AGPL-3.0-only",
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "SPDX-License-Identifier: MPL-2.0"],
    "ISC": [
        "Licensed under the ISC License.", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "EPL-2.0": [
        "Licensed under the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0",
        "Use, modification and distribution are subject to the Boost Software License, Version 1.0.",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA": ["Licensed under CC BY-NC-SA 4.0.",
                    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND": ["Licensed under CC BY-NC-ND 4.0.",
                    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Sentences that mention licences without granting one.
OTHER = [
    "He lost his driving license in May.", "A license fee applies to the software.", "The license plate was missing.",
    "See the file for the license of the version in use.", "All rights reserved.", "The public version was released late.",
    "They general public was asked to work under the terms of the contract.", "You need a fishing license for this.",
    "Software licensed to customers is not returned.", "Apache was a helicopter.", "He studied at MIT for a year.",
    "The permission to use the copy was granted.", "Please cc me by the end of the week.",
]
#: Words that tell nothing alone, in the languages of the texts.
COMMON = ("the of to a and in is this that you it or by be with are not for any as under with at on an from all has may "
          "can it its de la el en y que un una los las le les et des der die das und zu von").split()


def grams(found: Column, longest: int = LONGEST) -> Column:
    """Distinct runs of one to ``longest`` words that hold a telling word."""
    def of_length(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(found) - n + 1), lambda i: F.slice(found, i, n))
        return F.when(F.size(found) >= n, runs).otherwise(F.array().cast("array<array<string>>"))

    runs = [of_length(n) for n in range(1, longest + 1)]
    common = F.array(*map(F.lit, COMMON))
    telling = F.filter(F.concat(*runs), lambda run: F.size(F.array_except(run, common)) > 0)
    return F.array_distinct(F.transform(telling, lambda run: F.array_join(run, " ")))


#: A licence expression, and what stands between its licences.
_EXPRESSION, _BETWEEN = r"(?i)spdx-license-identifier\s*:\s*(.*)", r"(?i)\s+(?:or|and)\s+|[()]"
_UNDER = "licen[sc]ed|released|distributed|available|covered|offered|provided|published"
#: What is said not to hold: in a line up to the end of the sentence or to "but", and in
#: the words of a run of lines, where sentences have no end, a number of words.
_NOT_IN_LINE = rf"(?i)\bnot\s+(?:[a-z]+\s+){{0,3}}?(?:{_UNDER})\s+(?:under|by)\b(?:(?!\bbut\b|[.;](?:\s|$)).)*"
_NOT_IN_RUN = rf"\bnot (?:[a-z]+ ){{0,3}}?(?:{_UNDER}) (?:under|by)(?: (?!but )[^ ]+){{0,8}}"


def _line_words(line: Column) -> Column:
    denied = line.rlike(r"(?i)\bnot\s")
    return words(F.when(denied, F.regexp_replace(line, _NOT_IN_LINE, " ")).otherwise(line))


def _run_words(found: Column) -> Column:
    said = F.regexp_replace(F.array_join(found, " "), _NOT_IN_RUN, " ")
    return F.when(F.array_contains(found, "not"), F.array_remove(F.split(said, " "), "")).otherwise(found)


def documents_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, content, raw, lines``: the lines of every text, and their words."""
    raw = docs.select(F.col(key).alias("key"), F.xxhash64(text_or_empty(F.col(text))).alias("content"),
                      F.split(text_or_empty(F.col(text)), "\n").alias("raw"))
    return raw.select("*", F.transform("raw", _line_words).alias("lines"))


def _paragraph(line: Column, last: Column, part: Column, found: Column) -> Column:
    return F.struct(line.cast("int").alias("line"), last.cast("int").alias("last"), part.cast("int").alias("part"), found.alias("w"))


def paragraphs(cut: DataFrame, telling: list[str] | None = None, least: int = 1) -> DataFrame:
    """``key, content, line, last, part, w``: lines, licences of expressions, runs of lines.

    With ``telling`` words only paragraphs that hold ``least`` different ones, and runs
    whose first line holds one; a run goes up to an empty line or to as many words as the
    longest template has.
    """
    most = max(len(re.findall(r"[A-Za-z0-9]+", t)) for ts in TEMPLATES.values() for t in ts)

    def tells(found: Column, n: int) -> Column:
        return F.size(F.array_distinct(F.filter(found, lambda w: w.isin(telling)))) >= n if telling else F.size(found) > 0

    single = F.transform("lines", lambda w, i: _paragraph(i, i, F.lit(0), w))
    expressions = F.flatten(F.transform(
        F.filter(F.transform("raw", lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: x["p"].rlike(r"(?i)spdx.*\s(?:or|and)\s")),
        lambda x: F.transform(F.split(F.regexp_extract(x["p"], _EXPRESSION, 1), _BETWEEN), lambda e, j: _paragraph(
            x["i"], x["i"], j + 1, words(F.concat(F.lit("SPDX-License-Identifier: "), e))))))

    def run(i: Column) -> Column:
        none = F.struct(F.array().cast("array<string>").alias("w"), F.lit(0).alias("n"), F.lit(True).alias("open"))
        return F.aggregate(F.slice("lines", i + 1, most), none, lambda a, x: F.when(
            a["open"] & (F.size(x) > 0) & (F.size(a["w"]) < most),
            F.struct(F.concat(a["w"], F.slice(x, 1, most)).alias("w"), (a["n"] + 1).alias("n"), F.lit(True).alias("open")),
        ).otherwise(F.struct(a["w"].alias("w"), a["n"].alias("n"), F.lit(False).alias("open"))),
            lambda a: _paragraph(i, i + a["n"] - 1, F.lit(0), _run_words(a["w"])))

    # a run needs a second line, and words of a template in its first
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (
        F.size(F.coalesce(F.get("lines", i + 1), F.array().cast("array<string>"))) > 0) & F.exists(F.get("lines", i), lambda w: (
            w.isin(telling) if telling else F.lit(False))))
    every = F.concat(single, expressions, F.transform(starts, run))
    kept = F.filter(every, lambda x: tells(x["w"], least))
    return cut.select("key", "content", F.inline(kept))


def _examples(spark: SparkSession) -> DataFrame:
    """``family, template, w``: whole templates (numbered) and parts of them (null)."""
    rows = [(f, i, t) for i, (f, t) in enumerate((f, t) for f, ts in TEMPLATES.items() for t in ts)]
    rows += [(UNKNOWN, None, t) for t in OTHER]
    whole = spark.createDataFrame(rows, "family string, template int, text string").select(
        "family", "template", words(F.col("text")).alias("w"))
    # the halves and two thirds of the longer ones, as notices are often cut
    n = F.size("w")
    part = whole.where((n >= 12) & F.col("template").isNotNull()).select("family", F.explode(F.array(
        F.slice("w", F.lit(1), F.ceil(n * 2 / 3).cast("int")), F.slice("w", F.ceil(n / 3).cast("int"), n),
        F.slice("w", F.ceil(n / 4).cast("int"), F.ceil(n * 2 / 3).cast("int")))).alias("w"))
    return whole.unionByName(part.select("family", F.lit(None).cast("int").alias("template"), "w"))


@dataclass
class Model:
    """Small tables, bounded by the templates."""

    families: list[str]
    intercepts: list[float]
    weights: DataFrame  # gram, weights (array by family)
    templates: DataFrame  # gram, template, family
    sizes: DataFrame  # template, family, n_grams
    telling: list[str]
    least_telling: int


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", most_unknown: int = MOST_UNKNOWN) -> Model:
    spark = docs.sparkSession
    sample = bounded_sample(docs, key, most_unknown, docs.count())
    other = paragraphs(documents_of(sample, key, text)).where("line = last AND part = 0").groupBy("key", "content").agg(F.min_by("w", F.xxhash64("line", "content")).alias("w"))
    examples = _examples(spark).select("family", "template", grams(F.col("w")).alias("grams"), "w")
    known = examples.where(F.col("family") != UNKNOWN)
    vocabulary = staged(known.select(F.explode("grams").alias("gram")).distinct(), "licence-grams")
    names = [r["gram"] for r in vocabulary.orderBy("gram").collect()]
    # corpus paragraphs that read like a licence say nothing about unknown ones
    corpus = other.select(F.lit(UNKNOWN).alias("family"), grams(F.col("w")).alias("grams"))
    corpus = corpus.where(~F.exists("grams", lambda g: g.rlike("licen[sc]e|copyright|permission")))
    table = staged(examples.select("family", "grams", F.lit(1.0).alias("weight")).unionByName(
        corpus.withColumn("weight", F.lit(CORPUS_WEIGHT))), "licence-examples")
    families = sorted({*TEMPLATES, UNKNOWN})
    index = F.create_map(*[x for i, f in enumerate(families) for x in (F.lit(f), F.lit(float(i)))])
    counted = CountVectorizer(inputCol="grams", outputCol="features", binary=True)
    counter = counted.fit(spark.createDataFrame([(names,)], "grams array<string>"))
    vectors = counter.transform(
        table.withColumn("label", index[F.col("family")]))
    fitted = LogisticRegression(family="multinomial", regParam=1e-5, maxIter=80, weightCol="weight",
                                standardization=False).fit(vectors)
    matrix = fitted.coefficientMatrix.toArray()
    rows = [(g, [float(x) for x in matrix[:, i]]) for i, g in enumerate(counter.vocabulary)]
    weights = spark.createDataFrame(rows, "gram string, weights array<double>")
    templates = staged(known.where("template IS NOT NULL").select("family", "template", F.explode("grams").alias("gram")), "licence-templates")
    sizes = templates.groupBy("template", "family").agg(F.count("*").alias("n_grams"))
    content = known.select(F.explode("w").alias("word")).where(~F.col("word").isin(COMMON)).distinct()
    telling = sorted(r["word"] for r in content.collect())
    grams_of: dict[int, list[str]] = {}
    for r in templates.select("template", "gram").collect():
        grams_of.setdefault(r["template"], []).append(r["gram"])
    least = min(_least_words(g, set(telling)) for g in grams_of.values())
    return Model(families, [float(x) for x in fitted.interceptVector], weights, templates, staged(sizes, "licence-sizes"), telling, least)


def _least_words(found: list[str], telling: set[str]) -> int:
    """Different telling words without which not enough of a template's features can be there."""
    of_word = sorted((sum(w in g.split() for g in found) for w in telling), reverse=True)
    n, reached = 0, 0
    while reached < CONFIRMED * len(found):
        reached += of_word[n]
        n += 1
    return n


def _softmax(model: Model, features: DataFrame, by: list[str]) -> tuple[Column, DataFrame]:
    """Probabilities by family, as a column of the frame beside it: one row per ``by``."""
    met = features.join(F.broadcast(model.weights), "gram", "left")
    sums = [F.sum(F.coalesce(F.get("weights", F.lit(i)), F.lit(0.0))).alias(f"s{i}") for i in range(len(model.families))]
    added = met.groupBy(*by).agg(*sums)
    logits = F.array(*[F.col(f"s{i}") + F.lit(model.intercepts[i]) for i in range(len(model.families))])
    powers = added.select(*by, logits.alias("z")).select(
        *by, F.transform("z", lambda x: F.exp(x - F.array_max("z"))).alias("e"))
    total = powers.select(*by, "e", F.aggregate("e", F.lit(0.0), lambda a, x: a + x).alias("total"))
    return F.col("p"), total.select(*by, F.transform("e", lambda x: x / F.col("total")).alias("p"))


def licence_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """``key, content, line, last, family, probability, share``: the confirmed notices.

    ``share`` is how much of the closest template the paragraph holds. Of runs of lines that
    overlap the first counts, and none where one of its lines is a notice of the family by
    itself.
    """
    model = model or train(docs, key, text)
    by = ["key", "content", "line", "last", "part"]
    lines = paragraphs(documents_of(docs, key, text), model.telling, model.least_telling)
    features = staged(lines.select(*by, F.explode(grams(F.col("w"))).alias("gram")).distinct().join(
        F.broadcast(model.weights.select("gram")), "gram", "left_semi"), "licence-features")
    p, scored = _softmax(model, features, by)
    unknown = model.families.index(UNKNOWN)
    others = F.transform(p, lambda x, i: F.when(i == unknown, F.lit(-1.0)).otherwise(x))
    best = F.array_position(others, F.array_max(others)).cast("int")
    families = F.array(*map(F.lit, model.families))
    judged = scored.select(*by, (1 - F.element_at(p, unknown + 1)).alias("known"), F.element_at(families, best).alias("family"),
                           F.array_max(others).alias("probability"))
    held = features.join(F.broadcast(model.templates), "gram").groupBy(*by, "template", "family").agg(F.count("*").alias("n"))
    # of all templates the one of which the paragraph holds most
    shares = held.join(F.broadcast(model.sizes), ["template", "family"]).groupBy(*by).agg(
        F.max(F.struct((F.col("n") / F.col("n_grams")).alias("share"), "n", "family")).alias("top")).select(
        *[F.col(c).alias(f"_{c}") for c in by], F.col("top.share").alias("share"), F.col("top.family").alias("closest"))
    same = F.lit(True)
    for c in by:  # null keys stay comparable
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    compared = staged(judged.join(shares, same).select(*by, "known", "family", "probability", "share", "closest"), "licence-compared")
    level = compared.where(F.col("share") < CONFIRMED).agg(F.percentile_approx("known", 1 - PASSING, 10_000).alias("p")).first()["p"]
    least = min(0.9, max(0.5, float(level or 0.5)))
    found = compared.where((F.col("share") >= CONFIRMED) & (F.col("known") >= least) & (F.col("family") == F.col("closest")))
    return _once(found.select("key", "content", "line", "last", "family", "probability", "share").distinct())


def _once(found: DataFrame) -> DataFrame:
    """Without the runs that repeat a notice."""
    of = Window.partitionBy("key", "content", "family")
    single = F.col("line") == F.col("last")
    after = of.orderBy(F.col("line").desc(), F.col("last")).rowsBetween(Window.unboundedPreceding, 0)
    # the nearest line from here on that is a notice by itself, and the end of the runs before
    alone = found.withColumn("next", F.min(F.when(single, F.col("line"))).over(after)).where(
        single | F.col("next").isNull() | (F.col("next") > F.col("last")))
    before = Window.partitionBy("key", "content").orderBy("line", "last", F.desc("share"), "family").rowsBetween(Window.unboundedPreceding, -1)
    ends = alone.withColumn("reached", F.max(F.when(~single, F.col("last"))).over(before))
    return ends.where(single | F.col("reached").isNull() | (F.col("reached") < F.col("line"))).drop("next", "reached")


def licence_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """One row per document: the key, ``n_notices, families`` (sorted, comma-joined).

    Null and empty texts have none; rows that repeat key and text get equal results; a
    null key is a key like any other; an empty table gives no rows.
    """
    found = licence_paragraphs(docs, key, text, model).groupBy("key", "content").agg(
        F.count_distinct("line", "last").alias("n"), F.array_sort(F.collect_set("family")).alias("families"))
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text_or_empty(F.col(text))).alias("_content"))
    same = F.col("_key").eqNullSafe(F.col("key")) & (F.col("_content") == F.col("content"))
    return rows.join(found, same, "left").select(
        F.col("_key").alias(key), F.coalesce("n", F.lit(0).cast("long")).alias("n_notices"),
        F.array_join(F.coalesce("families", F.array().cast("array<string>")), ",").alias("families"))
