"""Licence scans by a trained paragraph classifier.

A logistic regression over sparse word n-grams (words and pairs of words) names
the licence family of a paragraph; a temperature fitted on held-out templates
(whole ones, not variants of learned ones) calibrates it, and a comparison
with the family's templates confirms it: enough shared n-grams, one of them the
family's alone.  What is not confirmed, or not likely enough, is ``unknown``.

A paragraph is a line, together with the lines it is wrapped onto: a line of 48
to 100 characters goes on if it ends no sentence and the next line has a word,
or if that one goes on in lower case.  Every paragraph is scored, except those that share
too few n-grams with any template to be confirmed, whatever their score (an
exact skip).  Paragraphs with a cue word are reported in any case, others if they
are confirmed or if only their probability or their wording keeps them from it.

The classifier learns the notices below and the licences' short names in
common phrases; the comparison uses the notices and the names.

Cases: null, empty and blank texts have no paragraphs; ties between families
go to the first by name; a paragraph that repeats is scored once and reported
at each of its places; repeated documents are rows each; an empty table gives no
rows.  Only DataFrame operations are used, also for training.
"""

from __future__ import annotations

import math
import operator
import re
from functools import partial

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapseries.llm.common import materialize

UNKNOWN = "unknown"

# Notices of each licence family, and sentences that are none.
TEMPLATES = {
    "AGPL": [
        "GNU Affero General Public License, version 3.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Released under the AGPL License.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "Artistic": [
        "Artistic License 2.0.",
        "Licensed under the Artistic License 2.0.",
        "This program is distributed under the terms of the Artistic License.",
        "SPDX-License-Identifier: Artistic-2.0",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This article is distributed under the terms of the Creative Commons Attribution License.",
        "This article is available under CC BY 4.0.",
        "Published under CC-BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Published under CC-BY-NC 4.0.",
        "This article is available under CC BY-NC 4.0.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "This article is available under CC BY-SA 4.0.",
    ],
    "CC0": [
        "Released under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "EPL": [
        "Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GPL License.",
        "Distributed under the GPL v3 or later.",
        "GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GPL-3.0-or-later",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "Released under the LGPL License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL": [
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Proprietary": [
        "Copyright 2020. All rights reserved.",
        "All rights reserved.",
        "Alle Rechte vorbehalten.",
        "Tous droits réservés.",
        "Tous droits reserves.",
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited without permission.",
    ],
    UNKNOWN: [
        "The driver lost the license after the accident and must apply for a new one.",
        "He was granted permission to enter the building in the morning.",
        "The copyright debate in parliament went on for several years.",
        "A fishing license is required for visitors of the lake.",
        "The warranty of the washing machine covers repairs for two years.",
        "Our licensed plumbers are available all week, call us today for a free quote.",
        "The government issued a search warrant for the house.",
        "She studied the history of copyright law at the university.",
        "Licensing fees for the broadcast rose again this season.",
        "The redistribution of land was the main demand of the movement.",
        "Please read the license terms of your vendor before you install the software.",
        "The agency renewed the operating license of the plant.",
        "Poetic license allows the author to bend the rules of grammar.",
        "The pilot holds a commercial license and works for a public company.",
        "Licensed under the Boost Software License, Version 1.0.",
        "Released under the zlib License.",
        "SPDX-License-Identifier: Zlib",
        "Licensed under the Common Development and Distribution License, Version 1.0.",
        "Licensed under the European Union Public License, version 1.2.",
        "Licensed under the SIL Open Font License, Version 1.1.",
        "Released under the University of Illinois NCSA License.",
        "Python Software Foundation License 2.0.",
        "Mit.",
        "Mit der Zeit ging es besser.",
        "Is.",
        "Be.",
        "Version 2.0.",
        "The terms of the agreement were published by the foundation.",
        "The software is available for any purpose.",
        "All rights of the workers were discussed.",
    ],
}
# Short names of each family, and of licences that are not told apart.
NAMES = {
    "AGPL": ["GNU Affero General Public License", "AGPLv3", "AGPL 3.0"],
    "Apache-2.0": ["Apache License", "Apache License 2.0", "Apache 2.0", "Apache License, Version 2.0"],
    "Artistic": ["Artistic License", "Perl Artistic License"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause", "New BSD License", "Simplified BSD License"],
    "CC-BY": ["CC BY 3.0", "CC BY 4.0", "Creative Commons Attribution 3.0", "Creative Commons Attribution License"],
    "CC-BY-NC": ["CC BY-NC 3.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial License"],
    "CC-BY-SA": ["CC BY-SA 3.0", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike License"],
    "CC0": ["CC0", "CC0 1.0 Universal", "public domain dedication"],
    "EPL": ["Eclipse Public License", "EPL 2.0"],
    "GPL": ["GNU General Public License", "GNU GPL", "GPLv2", "GPLv3", "GPL version 2", "GPL-2.0"],
    "ISC": ["ISC License", "ISC"],
    "LGPL": ["GNU Lesser General Public License", "GNU LGPL", "LGPLv2.1", "LGPLv3", "LGPL-2.1"],
    "MIT": ["MIT License", "The MIT License (MIT)", "Expat License"],
    "MPL": ["Mozilla Public License", "MPL 2.0", "Mozilla Public License 2.0"],
    UNKNOWN: ["Boost Software License", "zlib License", "Common Development and Distribution License",
              "European Union Public License", "SIL Open Font License", "NCSA License", "JSON License",
              "Public License", "vendor license", "driving license", "General Terms"],
}
# Phrases that names stand in.
PHRASES = ["{}", "License: {}", "Licensed under {}.", "Released under the {}.", "Distributed under the {} or later.",
           "This project is licensed under the terms of the {}.", "This code is {} licensed.",
           "The text is available under {}; see the file LICENSE.", "Copyright (c) 2019 the authors, {}"]
# Every third template of a family is held out to fit the temperature.
HOLD_OUT = 3
# Words too frequent to look for; where others do, lines are not picked by them.
FREQUENT = frozenset("a and at be by for in is it la mit of on or sa the this to under with".split()
                     + [str(d) for d in range(10)])
# A line and the break after it, if the text is wrapped there.
_WRAPPED = (r"[^\n]{48,100})(?:(?<![.!?:;][\r ]{0,2})\n(?=PLACE[^\w\n]{0,8}\w)"
            r"|\n(?=PLACE[^\w\n]{0,8}[a-z]))")
_PLACE = r"\d+\x02"
# A paragraph with any of these is reported even if it is no notice.
CUES = ("licen", "copyright", "warrant", "permission", "redistribut", "public domain",
        "creative commons", "all rights reserved", "cc0")


def has_cue(text: Column) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for cue in CUES:
        found = found | F.contains(low, F.lit(cue))
    return found


def paragraphs(text: Column) -> Column:
    """The (number of the first line, text) of each paragraph; wrapped lines stay joined by line ends."""
    def plain(line: Column, at: Column) -> Column:
        return F.struct(at.alias("line"), line.alias("text"))

    def placed(line: Column, at: Column) -> Column:
        return F.concat(at.cast("string"), F.lit("\x02"), line)

    def parted(row: Column) -> Column:
        line = F.substring_index(row, "\x02", 1)
        return F.struct(line.cast("int").alias("line"), F.regexp_replace(
            F.substr(row, F.length(line) + F.lit(2)), F.lit("\x01" + _PLACE), F.lit("\n")).alias("text"))
    # Each line carries its number while breaks are taken out.
    rows = F.array_join(F.transform(F.split(text, "\n", -1), placed), "\n")
    joined = F.regexp_replace(rows, F.lit("(?m)^(" + _PLACE + _WRAPPED.replace("PLACE", _PLACE)), F.lit("$1\x01"))
    return F.when(F.regexp_like(text, F.lit("(?m)^(" + _WRAPPED.replace("PLACE", ""))),
                  F.transform(F.split(joined, "\n", -1), parted)).otherwise(
        F.transform(F.split(text, "\n", -1), plain))


_HASHES = ["_h1", "_h2"]


def _hashes(text: str) -> list[Column]:
    """128 bits of a text as two numbers."""
    return [F.xxhash64(F.lit(name), F.col(text)).alias(name) for name in _HASHES]


def normal_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+", -1), lambda w: w != F.lit(""))


def ngrams(words: Column) -> Column:
    """Distinct words and pairs of neighbours."""
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pairs))


def _plain_grams(text: str) -> set[str]:
    """:func:`ngrams` of a template, in Python."""
    words = re.findall("[a-z0-9]+", text.lower())
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def may_confirm(words: Column, shapes: list[set[str]], least_similarity: float) -> Column:
    """False only for paragraphs whose similarity to every template is below the least.

    The similarity is the number of shared n-grams over the smaller of both
    sizes.  A paragraph no smaller than a template can miss only so many of the
    template's, so it has one of any larger number of them (the anchors), and
    the longest word of that one; of pairs of frequent words it has the pair.  A smaller one must find that share of its own
    n-grams among the templates'; each of its distinct words that no template
    has costs it the word and, unless it is the last, the pair that it begins.
    Only used to skip, never to confirm.
    """
    slack = 1e-3  # similarities are rounded
    if least_similarity <= slack:
        return F.lit(True)
    anchors: set[str] = set()
    pairs: set[str] = set()
    for shape in shapes:
        spare = len(shape) - max(1, math.ceil(least_similarity * len(shape) - slack))
        longest = {g: max(g.split(), key=lambda w: (w not in FREQUENT, len(w), w)) for g in shape}
        rarest = sorted(shape, key=lambda g: (longest[g] in FREQUENT, longest[g] in FREQUENT and " " not in g,
                                              -len(longest[g]), g))
        for g in rarest[:spare + 1]:
            if longest[g] in FREQUENT and " " in g:
                pairs.add(g)
            else:
                anchors.add(longest[g])
    known = sorted({w for shape in shapes for g in shape for w in g.split()})
    strange = F.size(F.array_distinct(F.filter(words, lambda w: ~w.isin(known))))
    missed = F.lit(2) * strange - F.lit(1)
    small = missed - F.lit(slack) <= F.lit(1 - least_similarity) * (F.lit(2) * F.size(words) - F.lit(1))
    found = F.exists(words, lambda w: w.isin(sorted(anchors))) | small
    spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    for pair in sorted(pairs):
        found = found | F.contains(spaced, F.lit(f" {pair} "))
    return (F.size(words) > 0) & found


def phrases(names: dict[str, list[str]]) -> dict[str, list[str]]:
    """Each name in each of the common phrases."""
    return {family: [p.format(name) for name in own for p in PHRASES] for family, own in names.items()}


def _merged(a: dict[str, list[str]], b: dict[str, list[str]]) -> dict[str, list[str]]:
    return {family: [*a.get(family, []), *b.get(family, [])] for family in {**a, **b}}


def _examples(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """Training paragraphs: each template whole, without each of its words, and its longer parts."""
    rows = [(family, n, text) for family, texts in sorted(templates.items()) for n, text in enumerate(texts)]
    base = (spark.createDataFrame(rows, "family string, template int, text string").coalesce(1)
            .withColumn("words", normal_words(F.col("text"))).withColumn("n", F.size("words")))
    cut = F.explode(F.sequence(F.lit(0), F.col("n")))
    without = base.select("*", cut.alias("at")).select(
        "family", "template", "at", F.filter("words", lambda w, i: i + 1 != F.col("at")).alias("words"))
    half = F.ceil(F.col("n") * 0.6).cast("int")
    parts = base.where("n >= 6").select("*", F.explode(F.sequence(F.lit(1), F.col("n") - half + 1)).alias("at")).select(
        "family", "template", (F.col("at") + 1000).alias("at"), F.slice("words", F.col("at"), half).alias("words"))
    rows = without.unionByName(parts)
    # A variant that is a text of another family as well ("CC BY-NC" without NC) teaches nothing.
    shared = rows.groupBy("words").agg(F.count_distinct("family").alias("owners"))
    rows = rows.join(shared, "words").where((F.col("owners") == 1) | (F.col("at") == 0)).drop("owners")
    return rows.withColumn("grams", ngrams(F.col("words")))


class LicenceModel:
    """Weights by n-gram, intercepts, temperature and templates, as small tables."""

    def __init__(self, spark: SparkSession, templates: dict[str, list[str]] | None = None, *,
                 reg: float = 0.002):
        names = NAMES if templates is None else {}
        templates = TEMPLATES if templates is None else templates
        lessons = _merged(templates, phrases(names))
        templates = _merged(templates, {f: own for f, own in names.items() if f != UNKNOWN})
        self.families = sorted(templates)
        self.shapes = [_plain_grams(t) for f, texts in sorted(templates.items()) if f != UNKNOWN for t in texts]
        label = F.array_position(F.array(*[F.lit(f) for f in self.families]), F.col("family")) - 1
        rows = materialize(_examples(spark, lessons).withColumn("label", label.cast("double")), "licence-examples")
        # Whole templates are held out, two or more of each family stay; the weights come from all.
        held_out = F.col("template") % HOLD_OUT == HOLD_OUT - 1
        vectors = CountVectorizer(inputCol="grams", outputCol="features", binary=True).fit(rows)
        data = vectors.transform(rows)
        regression = LogisticRegression(family="multinomial", regParam=reg, maxIter=60)
        scored = regression.fit(data.where(~held_out)).transform(data.where(held_out))
        self.temperature = self._temperature(
            scored.select("label", vector_to_array("rawPrediction").alias("z")))
        fitted = regression.fit(data)
        matrix = fitted.coefficientMatrix.toArray()
        self.intercepts = [float(x) for x in fitted.interceptVector.toArray()]
        weights = [(g, [float(x) for x in matrix[:, i]]) for i, g in enumerate(vectors.vocabulary)]
        # Bounded by the templates: their words and pairs of words.
        self.weights = materialize(spark.createDataFrame(weights, "gram string, w array<double>").coalesce(1),
                                   "licence-weights")
        owners: dict[str, set[str]] = {}
        for family, texts in templates.items():
            for text in texts:
                for gram in _plain_grams(text):
                    owners.setdefault(gram, set()).add(family)
        # What only one family's templates have: a notice of the family holds some of it.
        marks = [(f, sorted(g for g, of in owners.items() if of == {f})) for f in self.families]
        marks = spark.createDataFrame(marks, "family string, marks array<string>")
        shapes = _examples(spark, templates).where((F.col("at") == 0) & (F.col("family") != UNKNOWN))
        shapes = shapes.groupBy("family").agg(F.collect_list("grams").alias("templates")).join(marks, "family")
        self.templates = materialize(shapes, "licence-templates")

    @staticmethod
    def _temperature(scored: DataFrame) -> float:
        """The temperature of least log-loss on held-out paragraphs."""
        label, best, ratio = F.col("label").cast("int"), 1.0, 2.0
        for _ in range(3):  # each round looks closer around the best
            grid = [best * ratio ** (i / 3) for i in range(-9, 10)]
            losses = []
            for t in grid:
                scaled = F.transform("z", partial(operator.mul, F.lit(1 / t)))
                total = F.aggregate(scaled, F.lit(0.0), lambda a, x: a + F.exp(x))
                losses.append(F.avg(F.log(total) - F.get(scaled, label)))
            found = scored.agg(*losses).first()
            best = min((x, t) for x, t in zip(found, grid) if x is not None and math.isfinite(x))[1]
            ratio **= 1 / 6
        return best


def scan(docs: DataFrame, model: LicenceModel, *, id_col: str = "doc_id", text_col: str = "text",
         least_probability: float = 0.5, least_similarity: float = 0.6) -> DataFrame:
    """A row for each paragraph that has a cue word or resembles a notice.

    Columns: doc_id, paragraph (number of its first line, from 0), licence (the confirmed
    family or ``unknown``), family, probability, similarity, paragraph_text.
    """
    def paragraph(part: Column) -> Column:
        return F.struct(part["line"].alias("line"), part["text"].alias("text"),
                        normal_words(part["text"]).alias("words"))
    # Words come out of the generator, so they are not computed anew for each use.
    parts = F.explode(F.transform(paragraphs(F.col(text_col)), paragraph))
    lines = (docs.select(F.col(id_col).alias("doc_id"), parts.alias("_part"))
             .select("doc_id", F.col("_part.line").alias("paragraph"), F.col("_part.text").alias("paragraph_text"),
                     has_cue(F.col("_part.text")).alias("_cue"), F.col("_part.words").alias("_words"))
             .where(F.col("_cue") | may_confirm(F.col("_words"), model.shapes, least_similarity))
             .select("doc_id", "paragraph", "paragraph_text", "_cue", F.array_join("_words", " ").alias("_normal"))
             .select("*", *_hashes("_normal")))
    lines = materialize(lines, "licence-lines")
    # Equal paragraphs are judged once and told apart by 128 bits, so the text of one is shuffled once
    # and no row of a gram holds it. The cue is a key of both uses, which then share the shuffle.
    # (The null test, always true, is one that the join would put before one use only.)
    texts = (lines.where(F.col("_h1").isNotNull() & F.col("_h2").isNotNull()).groupBy(*_HASHES).agg(F.max("_normal").alias("_normal"), F.max("_cue").alias("_cue"))
             .select(*_HASHES, "_cue", ngrams(F.split("_normal", " ")).alias("grams")))
    n = len(model.families)
    sums = (texts.select(*_HASHES, "_cue", F.explode("grams").alias("gram"))
            .join(F.broadcast(model.weights), "gram").groupBy(*_HASHES, "_cue")
            .agg(*[F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(n)])).drop("_cue")
    z = F.array(*[(F.coalesce(F.col(f"z{i}"), F.lit(0.0)) + F.lit(b)) / F.lit(model.temperature)
                  for i, b in enumerate(model.intercepts)])
    scored = (texts.join(sums, _HASHES, "left").select(*_HASHES, "_cue", "grams", z.alias("z"))
              .withColumn("top", F.array_max("z"))
              .withColumn("family", F.get(F.array(*[F.lit(f) for f in model.families]),
                                          (F.array_position("z", F.col("top")) - 1).cast("int")))
              .withColumn("probability", 1 / F.aggregate(
                  "z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))))

    def likeness(template: Column) -> Column:
        shared = F.size(F.array_intersect(F.col("grams"), template)).cast("double")
        return F.round(shared / F.least(F.size("grams"), F.size(template)), 6)
    # One row for each family.
    judged = (scored.join(F.broadcast(model.templates), "family", "left")
              .withColumn("similarity", F.coalesce(F.array_max(F.transform("templates", likeness)), F.lit(0.0)))
              .withColumn("licence", F.when(
                  (F.col("family") != UNKNOWN) & (F.col("probability") >= least_probability)
                  & (F.col("similarity") >= least_similarity) & F.arrays_overlap("grams", "marks"), F.col("family")).otherwise(UNKNOWN)))
    resembles = (F.col("family") != UNKNOWN) & (F.col("similarity") >= least_similarity)
    judged = materialize(judged.where(F.col("_cue") | resembles).select(
        *_HASHES, "licence", "family", "probability", "similarity"), "licence-judged")
    return (lines.join(judged, _HASHES).where(F.col("_cue") | resembles)
            .select("doc_id", "paragraph", "licence", "family", "probability", "similarity", "paragraph_text"))
