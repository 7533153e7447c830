"""Licence scan of paragraphs: n-gram logistic regression, calibrated unknown class, template comparison.

The classifier knows the word pairs and triples of the ``TEMPLATES`` below, so its vocabulary and its weights are
bounded by them, whatever the corpus. It is trained by Spark's own logistic regression on variants of the templates
(shortened, inside other text, with other words between) against fragments of templates and ``SAMPLE`` paragraphs
drawn from the whole corpus, none of which holds a template. Probabilities are calibrated by a temperature on variants that were held out, and a family is named only
above a probability that held-out unknown paragraphs do not reach. A prediction counts if ``SHARE`` of the triples of
one of the family's templates stand in the paragraph.

The scan itself is joins and sums. The triples of every block, that is of consecutive lines with a word, meet the
broadcast templates first, and only blocks in which ``SHARE`` of some template stands go on. In these, every line, every
run of lines that a wrapped template may take, and the whole block are judged as paragraphs. Of nested paragraphs of one
family the innermost count, and a piece of a notice gives way to the longer notice that explains all of it.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanmill.llm.jaccard import PRUNED
from spanmill.session import cut_lineage, settings

#: Usual notices of licence families.
TEMPLATES = {
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "Licensed under the MIT license, see the LICENSE file for details.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
    ),
    "reserved": (
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher.",
    ),
}
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *TEMPLATES)
#: Paragraphs of the corpus that serve as unknown examples, at most.
SAMPLE = 400
VARIANTS, SHARE, MISTAKES = 24, 0.6, 0.02
#: Between blocks: at least one line without a word, whatever comment marks it holds.
BREAK = r"\n[^A-Za-z0-9]*\n"
#: Comment marks that are words; no template holds them.
MARKS = ("rem", "dnl")


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def grams(words: list[str]) -> list[str]:
    """Different pairs and triples of neighbouring words."""
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)))


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def gram_array(text: Column) -> Column:
    """``grams(plain_words(text))`` as a column."""
    words = word_array(text)

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
        joined = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
        return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(runs(2), runs(3)))


def template_grams() -> list[tuple[str, list[str]]]:
    """(family, triples) of every template; pairs for one of two words."""
    return [
        (family, [g for g in grams(plain_words(text)) if len(g.split()) == 3 or len(plain_words(text)) < 3])
        for family, texts in TEMPLATES.items() for text in texts
    ]


def holds_template(words: list[str]) -> bool:
    """Whether ``SHARE`` of the triples of some template stand in ``words``."""
    own = set(grams(words))
    return any(len(own.intersection(template)) >= SHARE * len(template) for _, template in template_grams())


def variants(seed: int, count: int) -> list[tuple[str, str]]:
    """(family, text): templates shortened, interrupted and inside other words; and fragments of them as unknown."""
    draw = random.Random(seed)
    filler = [w for texts in TEMPLATES.values() for text in texts for w in plain_words(text) if len(w) > 3]
    found = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = plain_words(text)
            for k in range(count):
                kept = list(words)
                if k % 3 == 1 and len(kept) > 8:
                    cut = draw.randrange(0, len(kept) // 4 + 1)
                    kept = kept[cut:] if draw.random() < 0.5 else kept[: len(kept) - cut]
                if k % 3 == 2 and len(kept) > 5:
                    kept.insert(draw.randrange(len(kept)), "x" + str(draw.randrange(1000)))
                around = [["y" + str(draw.randrange(1000)) for _ in range(draw.randrange(30))] for _ in range(2)]
                found.append((family, " ".join([*around[0], *kept, *around[1]])))
                if k % 3 == 0:
                    size = 2 if len(words) < 12 else 4
                    at = draw.randrange(len(words))
                    fragment = words[at : at + size] + draw.sample(filler, 2)
                    # A long template may hold a short one.
                    if not holds_template(fragment):
                        found.append((UNKNOWN, " ".join(fragment)))
    return found


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, no, paragraph): the lines of every text that hold a word."""
    split = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "paragraph"))
    return split.filter(F.col("paragraph").rlike("[A-Za-z0-9]"))


@dataclass(frozen=True)
class LicenceModel:
    """Weights of each gram for each of ``FAMILIES``, their intercepts, the temperature and the least probability."""

    weights: dict[str, tuple[float, ...]]
    intercepts: tuple[float, ...]
    temperature: float
    least: float

    def probabilities(self, text: str) -> list[float]:
        """By family; the plain counterpart of what ``scan`` computes."""
        sums = list(self.intercepts)
        for gram in grams(plain_words(text)):
            for k, w in enumerate(self.weights.get(gram, ())):
                sums[k] += w
        top = max(sums)
        odds = [math.exp((s - top) / self.temperature) for s in sums]
        return [o / sum(odds) for o in odds]

    def family(self, text: str) -> str:
        chances = self.probabilities(text)
        best = max(range(1, len(FAMILIES)), key=lambda k: chances[k])
        return FAMILIES[best] if chances[best] >= self.least and chances[best] > chances[0] else UNKNOWN


def vocabulary() -> list[str]:
    return sorted({gram for texts in TEMPLATES.values() for text in texts for gram in grams(plain_words(text))})


def unknown_examples(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text): at most ``sample`` whole paragraphs in which no template stands, spread by hash over all of ``docs``."""
    lines = paragraphs(docs).select("paragraph", F.xxhash64("doc_id", "hash", "no").alias("at"))
    # The bound lets about twice as many lines through as the limit asks, so that no task sorts more.
    bound = (8 * sample << 40) // max(lines.count(), 1) + 1
    drawn = lines.filter(F.shiftrightunsigned("at", 24) < bound).orderBy("at", "paragraph").limit(4 * sample)
    drawn = drawn.select("paragraph", "at", gram_array(F.col("paragraph")).alias("own"))
    holds = [F.size(F.array_intersect("own", F.lit(template))) >= SHARE * len(template) for _, template in template_grams()]
    return drawn.filter(~reduce(Column.__or__, holds)).orderBy("at", "paragraph").limit(sample).select(F.col("paragraph").alias("text"))


def train(docs: DataFrame, sample: int = SAMPLE, seed: int = 7) -> LicenceModel:
    """Fit on template variants and at most ``sample`` paragraphs of ``docs``; calibrate on other variants."""
    spark = docs.sparkSession
    known = vocabulary()
    own = spark.createDataFrame([(float(FAMILIES.index(family)), text) for family, text in variants(seed, VARIANTS)], "label double, text string")
    other = cut_lineage(unknown_examples(docs, sample)).select(F.lit(0.0).alias("label"), "text")
    rows = own.union(other).select("label", gram_array(F.col("text")).alias("grams"))
    counts = CountVectorizerModel.from_vocabulary(known, inputCol="grams", outputCol="features", minTF=1.0)
    counts.setBinary(True)
    fitted = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60).fit(counts.transform(rows.coalesce(4)))
    matrix = fitted.coefficientMatrix.toArray()
    model = LicenceModel(
        {gram: tuple(float(x) for x in matrix[:, i]) for i, gram in enumerate(known)}, tuple(float(x) for x in fitted.interceptVector), 1.0, 0.0
    )
    held = variants(seed + 1, VARIANTS // 3)
    best = min((_loss(model, held, t), t) for t in (0.5, 0.75, 1.0, 1.5, 2.0, 3.0))[1]
    model = LicenceModel(model.weights, model.intercepts, best, 0.0)
    unknown = sorted(max(model.probabilities(text)[1:]) for family, text in held if family == UNKNOWN)
    return LicenceModel(model.weights, model.intercepts, best, max(0.5, unknown[int(len(unknown) * (1 - MISTAKES))]))


def _loss(model: LicenceModel, held: list[tuple[str, str]], temperature: float) -> float:
    model = LicenceModel(model.weights, model.intercepts, temperature, 0.0)
    return -sum(math.log(max(model.probabilities(text)[FAMILIES.index(family)], 1e-12)) for family, text in held)


def _vocabulary_frame(spark: SparkSession, model: LicenceModel, size: int) -> DataFrame:
    """The grams of ``size`` words by hash, with their number and weights; as many rows as the templates have."""
    rows = [(number, gram, *weights) for number, (gram, weights) in enumerate(model.weights.items()) if len(gram.split()) == size]
    frame = spark.createDataFrame(rows, "gram int, words string, " + ", ".join(f"w{k} double" for k in range(len(FAMILIES))))
    return frame.withColumn("key", F.xxhash64(*(F.split("words", " ")[i] for i in range(size)))).drop("words")


def scan(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """(doc_id, hash, no, grams, family, probability, contained, confirmed) of every line that is not unknown."""
    return judge(paragraphs(docs), ["doc_id", "hash", "no"], model)


def judge(texts: DataFrame, keys: list[str], model: LicenceModel) -> DataFrame:
    """``keys``, grams, family, probability, contained and confirmed of every ``paragraph`` that is not unknown."""
    spark = texts.sparkSession
    listed = texts.select(*keys, word_array(F.col("paragraph")).alias("w"))
    size = F.size("w")
    runs = listed.filter(size >= 2).select(
        *keys,
        F.inline(F.arrays_zip(F.slice("w", 1, size - 1).alias("a"), F.slice("w", 2, size - 1).alias("b"), F.slice("w", 3, F.greatest(size - 2, F.lit(0))).alias("c"))),
    ).toDF(*keys, "a", "b", "c")
    columns = [f"w{k}" for k in range(len(FAMILIES))]
    pairs, triples = (F.broadcast(_vocabulary_frame(spark, model, n)) for n in (2, 3))
    met = runs.withColumn("key", F.xxhash64("a", "b")).join(pairs, "key")
    three = met.filter("c IS NOT NULL").select(*keys, F.xxhash64("a", "b", "c").alias("key")).join(triples, "key")
    # A gram counts once for a paragraph, also if its row is there twice.
    grams_met = met.select(*keys, "gram", *columns).union(three.select(*keys, "gram", *columns)).distinct()
    sums = grams_met.groupBy(*keys).agg(F.collect_set("gram").alias("grams"), *(F.sum(c).alias(c) for c in columns))
    scores = F.array(*((F.col(c) + F.lit(b)) / F.lit(model.temperature) for c, b in zip(columns, model.intercepts, strict=True)))
    judged = sums.select(*keys, "grams", scores.alias("z"))
    odds = F.transform("z", lambda z: F.exp(z - F.array_max("z")))
    judged = judged.select(*keys, "grams", odds.alias("odds")).withColumn("total", F.aggregate("odds", F.lit(0.0), lambda s, x: s + x))
    best = F.array_max(F.slice("odds", 2, len(FAMILIES) - 1))
    names = F.array(*(F.lit(f) for f in FAMILIES))
    judged = judged.select(
        *keys, "grams", (best / F.col("total")).alias("probability"), (best > F.col("odds")[0]).alias("over_unknown"),
        F.element_at(names, (F.array_position(F.slice("odds", 2, len(FAMILIES) - 1), best) + 1).cast("int")).alias("family"),
    ).filter(F.col("over_unknown") & (F.col("probability") >= model.least)).drop("over_unknown")
    numbers = {gram: i for i, gram in enumerate(model.weights)}
    templates = spark.createDataFrame(
        [(family, [numbers[g] for g in template]) for family, template in template_grams()],
        "family string, template array<int>",
    )
    contained = F.size(F.array_intersect("grams", "template")) / F.size("template")
    return (
        judged.join(F.broadcast(templates), "family")
        .groupBy(*keys, "family", "probability").agg(F.first("grams").alias("grams"), F.max(contained).alias("contained"))
        .withColumn("confirmed", F.col("contained") >= SHARE)
    )


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, block, body): the runs of consecutive lines that hold a word."""
    split = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.posexplode(F.split(F.coalesce("text", F.lit("")), BREAK)).alias("block", "body"))
    return split.filter(F.col("body").rlike("[A-Za-z0-9]"))


def _text_words(text: Column) -> Column:
    """The words of a line or block, without comment marks."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: ~w.isin("", *MARKS))


def with_templates(docs: DataFrame) -> DataFrame:
    """(hash, block): the blocks in which ``SHARE`` of the triples of some template stand."""
    spark = docs.sparkSession
    triples = [(number, gram, len(template), *gram.split()) for number, (_, template) in enumerate(template_grams()) for gram in template]
    wanted = spark.createDataFrame(triples, "template int, gram string, asked int, a string, b string, c string")
    wanted = wanted.select("template", "gram", "asked", F.xxhash64("a", "b", "c").alias("key"))
    size = F.size("w")
    runs = blocks(docs).select("hash", "block", _text_words(F.col("body")).alias("w")).filter(size >= 3).select(
        "hash", "block", F.inline(F.arrays_zip(F.slice("w", 1, size - 2).alias("a"), F.slice("w", 2, size - 2).alias("b"), F.slice("w", 3, size - 2).alias("c"))),
    ).toDF("hash", "block", "a", "b", "c")
    met = runs.select("hash", "block", F.xxhash64("a", "b", "c").alias("key")).join(F.broadcast(wanted), "key").select("hash", "block", "template", "asked", "gram").distinct()
    held = met.groupBy("hash", "block", "template", "asked").agg(F.count(F.lit(1)).alias("held"))
    return held.filter(F.col("held") >= SHARE * F.col("asked")).select("hash", "block").distinct()


def units(kept: DataFrame) -> DataFrame:
    """(doc_id, hash, block, first, last, paragraph): what is judged of the blocks ``kept``.

    Single lines, the whole block, and runs of lines in which a template may stand wrapped: the lines between the first
    and the last, of which each has a word, hold fewer words than the longest template.
    """
    longest = max(len(plain_words(text)) for texts in TEMPLATES.values() for text in texts)
    lines = F.transform(F.filter(F.split("body", "\n"), lambda x: x.rlike("[A-Za-z0-9]")), lambda x: _text_words(x))
    listed = kept.select("doc_id", "hash", "block", F.filter(lines, lambda w: F.size(w) > 0).alias("lines")).withColumn("n", F.size("lines"))
    keys = ["doc_id", "hash", "block"]
    whole = listed.filter("n > 1").select(*keys, F.lit(1).alias("first"), F.col("n").alias("last"), F.array_join(F.flatten("lines"), " ").alias("paragraph"))
    starts = F.transform(F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.col("n") > 0), lambda i: F.struct(i.alias("first"), F.slice("lines", i, F.lit(longest + 1)).alias("ahead")))
    begun = listed.filter("n > 0").select(*keys, F.inline(starts))
    between = lambda k: F.aggregate(F.slice("ahead", F.lit(2), F.greatest(k - 2, F.lit(0))), F.lit(0), lambda total, w: total + F.size(w))
    ends = F.filter(F.sequence(F.lit(1), F.size("ahead")), lambda k: between(k) <= longest - 2)
    spans = begun.select(*keys, "first", "ahead", F.explode(ends).alias("k")).select(
        *keys, "first", (F.col("first") + F.col("k") - 1).alias("last"), F.array_join(F.flatten(F.slice("ahead", F.lit(1), F.col("k"))), " ").alias("paragraph")
    )
    return spans.union(whole)


def notices(confirmed: DataFrame, model: LicenceModel) -> DataFrame:
    """(doc_id, hash, block, first, last, family): one row for each notice of the ``confirmed`` units."""
    block = Window.partitionBy("doc_id", "hash", "block")
    family = Window.partitionBy("doc_id", "hash", "block", "family")
    # Innermost: no other unit of the family lies within.
    inside = F.min("last").over(family.orderBy(F.desc("first"), "last").rowsBetween(Window.unboundedPreceding, -1))
    inner = confirmed.withColumn("inside", inside).filter(F.col("inside").isNull() | (F.col("inside") > F.col("last"))).drop("inside")
    # Explained: a longer notice of another family, which has all triples that were met, lies around.
    numbers = {gram: i for i, gram in enumerate(model.weights)}
    own = {f: sorted({numbers[g] for name, template in template_grams() if name == f for g in template}) for f in TEMPLATES}
    around = block.orderBy("first").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reached = inner.select("*", *(F.max(F.when(F.col("family") == f, F.col("last"))).over(around).alias(f"reach_{k}") for k, f in enumerate(own)))
    every = F.lit(sorted({n for ids in own.values() for n in ids}))
    evidence = F.coalesce(*(F.when(F.col("family") == f, F.array_intersect("grams", F.lit(ids))) for f, ids in own.items()), F.array_intersect("grams", every))
    explained = [
        (F.col("family") != f) & F.coalesce(F.col(f"reach_{k}") >= F.col("last"), F.lit(False)) & (F.size(F.array_except("evidence", F.lit(ids))) == 0)
        for k, (f, ids) in enumerate(own.items())
    ]
    left = reached.withColumn("evidence", evidence).filter(~reduce(Column.__or__, explained))
    # Units of a family that overlap are pieces of one notice.
    before = F.lag("last").over(family.orderBy("first"))
    return left.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") < F.col("first"))).select("doc_id", "hash", "block", "first", "last", "family")


def licence_report(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed and families of every row of ``docs`` (doc_id, text).

    n_paragraphs counts the lines with a word. n_licensed counts the lines whose predicted family a template confirms,
    and the notices that only several lines of a block together confirm; families names them, sorted and comma-joined,
    empty if there are none.

    Edge cases: null and empty texts have no paragraphs; paragraphs without a known pair of words are unknown; a wrapped
    notice with so many foreign words in it that its inner lines are longer than the longest template is found only if
    its block as a whole is judged to be of its family; repeated
    rows get equal results, null ids are kept; an empty table gives an empty result. Other columns are ignored.
    """
    known = docs.select("doc_id", "text")
    model = train(known, sample)
    listed = cut_lineage(with_templates(known))
    with settings(docs.sparkSession, PRUNED):
        kept = cut_lineage(blocks(known).join(listed.filter("block >= 0"), ["hash", "block"], "left_semi"))
    judged = judge(cut_lineage(units(kept)), ["doc_id", "hash", "block", "first", "last"], model).filter("confirmed")
    found = notices(cut_lineage(judged), model)
    per_document = found.groupBy("doc_id", "hash").agg(
        F.count(F.lit(1)).alias("n_licensed"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families")
    )
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda p: p.rlike("[A-Za-z0-9]"))
    base = known.select("doc_id", F.xxhash64("text").alias("hash"), F.size(lines).cast("long").alias("n_paragraphs"))
    joined = base.alias("b").join(per_document.alias("f"), F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b.hash") == F.col("f.hash")), "left")
    return joined.select("b.doc_id", "n_paragraphs", F.coalesce("n_licensed", F.lit(0)).alias("n_licensed"), F.coalesce("families", F.lit("")).alias("families"))
