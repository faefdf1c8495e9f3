"""The trained operators: language, quality and licence."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapseries.llm import langid, license_scan, quality
from gapseries.llm import queries as q
from tests.conftest import SF01
from tests.llm.helpers import DOCS, clashing, odd_docs, odd_rows


# ------------------------------------------------------------------ language ---
def test_language_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = [r for r in q.op1(spark, SF01).collect()]
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_mixture_proportions(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    langs, probs = langid.train(docs, F.lit(True))
    text = {r.lang: r.text for r in docs.where("n_chars between 3000 and 4000").collect()}
    mixed = (text["en"][:3000] + " " + text["de"][:1000]).encode()
    which, share = langid.infer(mixed, probs)
    assert [langs[i] for i in which] == ["en", "de"] and 0.65 < share[0] < 0.85
    assert share.sum() == pytest.approx(1.0)
    which, _ = langid.infer(text["fr"].encode(), probs)
    assert [langs[i] for i in which] == ["fr"]


def test_em_climbs():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(50), size=3).T
    weight = rng.integers(1, 9, 50).astype(float)
    pi, lls = np.full(3, 1 / 3), []
    for _ in range(20):
        pi, ll = langid._em(p, weight, pi, 1, 0.0)
        lls.append(ll)
    assert np.all(np.diff(lls) >= -1e-9)
    grid = [weight @ np.log(p @ np.array([a, b, 1 - a - b])) for a in np.linspace(0, 1, 21)
            for b in np.linspace(0, 1 - a, 21)]
    assert langid._em(p, weight, np.full(3, 1 / 3), 2000, 0)[1] >= max(grid) - 1e-6


def test_language_odd_rows(spark):
    df = clashing(odd_docs(spark))
    langs, probs = langid.train(df, F.lit(True))
    assert langs == ["de", "en", "fr"]
    out = langid.predict(df, langs, probs)
    assert out.columns == [*df.columns, "_lang_pred", "_score", "_languages", "proportions"]
    for r in out.collect():
        und = r.text is None or not any(c.isalpha() for c in r.text)
        assert (r["_lang_pred"] == "und") == und and (r["_score"] == 0) == und
    none, empty = langid.train(df.where("false"), F.lit(True))
    assert none == [] and {r.lang_pred for r in langid.predict(odd_docs(spark), none, empty).collect()} == {"und"}
    assert langid.predict(spark.createDataFrame([], DOCS), langs, probs).count() == 0


@pytest.mark.parametrize("text,letter", [("", False), ("12 .-\n", False), ("é", True), ("…—", False), ("1a", True),
                                         ("日", True)])
def test_has_letter(text, letter):
    assert langid.has_letter(text.encode()) == letter


# ------------------------------------------------------------------- quality ---
def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    rows = q.op5(spark, SF01).collect()
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    s, y = np.array(held).T
    assert auc(s, y) > 0.9


def test_flat_trees_equal_walking():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    forest = quality.fit(x, y, trees=40)
    fresh = rng.normal(size=(300, 5))

    def walk(row, at):
        while forest.left[at] != at:
            at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
        return forest.value[at]
    plain = [1 / (1 + np.exp(-(forest.base + sum(walk(r, k) for k in forest.roots)))) for r in fresh]
    assert np.allclose(forest.score(fresh), plain)
    truth = ((fresh[:, 0] > 0.2) ^ (fresh[:, 3] > 0)).astype(float)
    assert auc(forest.score(fresh), truth) > 0.97


def test_no_or_one_sided_labels():
    x = np.ones((50, 3))
    assert quality.fit(np.empty((0, 3)), np.empty(0)).score(x[:1]).tolist() == [0.5]
    assert quality.fit(x, np.ones(50)).score(x)[0] > 0.99
    assert np.allclose(quality.fit(x, np.r_[np.ones(25), np.zeros(25)]).score(x), 0.5)
    assert len(quality.fit(x, np.ones(50)).score(x[:0])) == 0


def test_quality_odd_rows(spark):
    df = clashing(odd_docs(spark))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 0), (6, 0, 0), (5, 1, None)],
                                   "doc_id long, quality int, toxic int")
    forest = quality.train(df, labels, F.lit(True))
    out = quality.score(df, forest)
    assert out.columns == [*df.columns, "_score", "_predicted"] and out.count() == len(odd_rows())
    assert all(0 <= r["_score"] <= 1 for r in out.collect())
    assert quality.score(spark.createDataFrame([], DOCS), forest).count() == 0
    assert quality.train(df, labels.where("false"), F.lit(True)).score(np.ones((1, len(quality.FEATURES)))) == 0.5


def test_statistics_cover_the_whole_text():
    text = b"word " * 50_000
    a, b = quality.statistics(text), quality.statistics(text + b"$$$$ " * 10_000)
    symbols = quality.FEATURES.index("symbol_share")
    assert a[symbols] == 0 and b[symbols] == pytest.approx(40_000 / 300_000)
    assert not quality.statistics(None).any() and not quality.statistics(b"").any()
    assert np.isfinite(quality.statistics(b"\n\n \n")).all()


# ------------------------------------------------------------------- licence ---
@pytest.fixture(scope="module")
def licences(spark):
    return license_scan.LicenceModel(spark)


NOTICES = {
    "GPL": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
}


def test_given_documents(spark, licences):
    """Every line of the tables that is a notice is named; nothing else is confirmed."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    want = sorted((r.doc_id, n, family) for r in docs.collect() for n, line in enumerate(r.text.split("\n"))
                  for family, notice in NOTICES.items() if notice in line)
    got = sorted((r.doc_id, r.paragraph, r.licence) for r in license_scan.scan(docs, licences).collect()
                 if r.licence in NOTICES)
    assert want and got == want


def test_variants_and_unknown(spark, licences):
    rows = [(1, "licensed UNDER the apache license version 2.0"), (2, "This file is released under the MIT license"),
            (3, "The museum was granted permission to show the painting, said its licensed guide"),
            (4, "She lost her driving license in March and bought a new warranty for the car"),
            (5, "SPDX-License-Identifier: MPL-2.0"), (6, None), (7, ""), (8, "x\n\nReleased under the BSD License.\ny")]
    got = {r.doc_id: (r.paragraph, r.licence) for r in license_scan.scan(
        spark.createDataFrame(rows, "doc_id long, text string"), licences).collect()}
    assert got == {1: (0, "Apache-2.0"), 2: (0, "MIT"), 3: (0, "unknown"), 4: (0, "unknown"), 5: (0, "MPL"),
                   8: (2, "BSD")}


def test_licence_odd_rows(spark, licences):
    text = "Licensed under CC BY-NC 4.0.\n" * 3
    rows = [(1, text), (1, text), (None, text), (2, "licence " + "word " * 50_000)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("paragraph", F.lit(-1))
    out = license_scan.scan(df, licences)
    found = [r for r in out.collect() if r.licence == "CC-BY-NC"]
    assert sorted((str(r.doc_id), r.paragraph) for r in found) == sorted(
        [("1", i) for i in (0, 0, 1, 1, 2, 2)] + [("None", i) for i in range(3)])
    assert [r.licence for r in out.collect() if r.doc_id == 2] == ["unknown"]
    assert license_scan.scan(spark.createDataFrame([], DOCS), licences).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_calibrated(licences):
    assert licences.temperature > 0 and license_scan.UNKNOWN in licences.families


def test_notices_without_cue_words(spark, licences):
    rows = [(1, "GPL-3.0-or-later"), (2, "x\nPublished under CC-BY-NC 4.0\ny"), (3, "The lake was calm in the morning.")]
    got = {r.doc_id: (r.paragraph, r.licence) for r in license_scan.scan(
        spark.createDataFrame(rows, "doc_id long, text string"), licences).collect()}
    assert got == {1: (0, "GPL"), 2: (1, "CC-BY-NC")}


@pytest.mark.parametrize("least", [0.6, 0.35, 0.9, 0.0])
def test_skipped_lines_cannot_be_confirmed(spark, licences, monkeypatch, least):
    """Lines of template words and strange ones: the same rows with the skip and without."""
    rnd = random.Random(4)
    texts = [t for x in license_scan.TEMPLATES.values() for t in x]
    rows = []
    for i in range(600):
        words = rnd.choice(texts).split()
        at = rnd.randrange(len(words))
        words = words[at:at + rnd.randint(1, 12)] + rnd.choices(["qua", "zwo", "the", "of"], k=rnd.randint(0, 12))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = license_scan.scan(docs, licences, least_similarity=least).collect()
    monkeypatch.setattr(license_scan, "may_confirm", lambda *_: F.lit(True))
    assert sorted(got) == sorted(license_scan.scan(docs, licences, least_similarity=least).collect())
    assert any(r.licence != license_scan.UNKNOWN for r in got)


def test_each_notice_of_the_tables_and_other_licences(spark, licences):
    """Notices of the tables and of related licences are told apart; licences not trained on are unknown."""
    want = NOTICES | {"Proprietary": "All rights reserved.", "AGPL": "GNU Affero General Public License, version 3",
                      "EPL": "Eclipse Public License 2.0", "Artistic": "Artistic License 2.0",
                      "CC-BY": "This article is available under CC BY 4.0.", "LGPL": "SPDX-License-Identifier: LGPL-3.0"}
    other = ["Microsoft Public License (Ms-PL)", "Licensed under the Open Software License 3.0",
             "Licensed under the IBM Public License Version 1.0", "SPDX-License-Identifier: Vim",
             "This program is distributed under the terms of the Sleepycat License.",
             "Released under the PostgreSQL License.", "Licensed under the Academic Free License, Version 3.0."]
    rows = [*want.items(), *((license_scan.UNKNOWN, text) for text in other)]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in license_scan.scan(docs, licences).collect()}
    assert [(got.get(i, license_scan.UNKNOWN), text) for i, (_, text) in enumerate(rows)] == rows


def test_temperature_is_of_whole_templates(spark):
    """Held-out templates that the others mislead about call for little confidence."""
    templates = {"p": ["a1 a2 a3 a4", "a5 a6 a7 a8", "b1 b2 b9 b10"], "q": ["b1 b2 b3 b4", "b5 b6 b7 b8", "a1 a2 a9 a10"],
                 license_scan.UNKNOWN: ["c1 c2 c3 c4", "c5 c6 c7 c8"]}
    assert license_scan.LicenceModel(spark, templates).temperature >= 2.8


# Notices and sentences written apart from the module's.
SHORT = {
    "MIT License": "MIT", "The MIT License": "MIT", "License: MIT": "MIT", "MIT-licensed": "MIT",
    "All code here is MIT licensed.": "MIT", "The code is released under the MIT licence": "MIT",
    "Apache License": "Apache-2.0", "Code is under the Apache 2.0 license.": "Apache-2.0",
    "BSD 3-Clause License": "BSD", "License: BSD-2-Clause": "BSD", "Distributed under a BSD license": "BSD",
    "GNU GENERAL PUBLIC LICENSE": "GPL", "GPLv3": "GPL", "Licensed under GPLv2 or later.": "GPL",
    "GNU Lesser General Public License v2.1": "LGPL", "Mozilla Public License Version 2.0": "MPL",
    "CC BY-SA 3.0": "CC-BY-SA", "This image is CC BY-SA 4.0": "CC-BY-SA", "ISC License (ISC)": "ISC",
    "Creative Commons Attribution 3.0": "CC-BY", "Licensed under the EPL 2.0": "EPL", "License: AGPLv3": "AGPL",
}
ORDINARY = [
    "She renewed her fishing license before the public meeting began.", "Die Lizenz wurde mit der Zeit teurer.",
    "The domain was sold to a public company in March.", "Er ging mit dem Hund in den Park.", "Version 2.0",
    "The foundation published its general terms for the public.", "He used code from an older project.",
    "Apache helicopters were seen over the lake.", "The artistic director left under a cloud.",
    "An eclipse was visible in the north.", "They are available all week and free of charge.",
    "The commercial was released under great secrecy.", "Common people met in the creative quarter.",
]
WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "BSD": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:""",
    "Apache-2.0": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.""",
    "GPL": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.""",
}


def test_short_notices_and_ordinary_sentences(spark, licences):
    texts = [*SHORT, *ORDINARY]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {texts[r.doc_id]: r.licence for r in license_scan.scan(docs, licences).collect()}
    missed = {t: got.get(t) for t, f in SHORT.items() if got.get(t) != f}
    assert len(missed) <= 0.1 * len(SHORT), missed
    assert {t: got[t] for t in ORDINARY if got.get(t, license_scan.UNKNOWN) != license_scan.UNKNOWN} == {}


def test_wrapped_notices_are_one_paragraph(spark, licences):
    rows = [(i, "Title\n\n" + text + "\n\nThe lake was calm.") for i, text in enumerate(WRAPPED.values())]
    out = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), licences).collect()
    assert sorted((r.doc_id, r.paragraph, r.licence) for r in out) == [
        (i, 2, family) for i, family in enumerate(WRAPPED)]
    assert {r.doc_id: r.paragraph_text for r in out} == dict(enumerate(WRAPPED.values()))


def test_paragraphs(spark):
    long = "word " * 12
    texts = ["", "a\n\nb", f"{long}\ngoes on\nnew", f"{long}x.\nNew one", f"{long}\n\nafter", f"{long}\n# more\n",
             "\n".join([long.strip()] * 3), None, "w" * 300 + "\nshort", f"{long}\r\nmore\x02"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.p and [(x.line, x.text) for x in r.p] for r in docs.select(
        "i", license_scan.paragraphs(F.col("text")).alias("p")).collect()}
    lines = {i: list(enumerate(t.split("\n"))) for i, t in enumerate(texts) if t is not None}
    assert [got[i] for i in (0, 1, 3, 4, 8)] == [lines[i] for i in (0, 1, 3, 4, 8)] and got[7] is None
    assert got[2] == [(0, f"{long}\ngoes on"), (2, "new")]
    assert got[5] == [(0, f"{long}\n# more"), (2, "")]
    assert got[6] == [(0, texts[6])] and got[9] == [(0, texts[9])]


def test_probabilities_are_calibrated(spark, licences):
    """Of the reported notices and sentences, none learned, the mean probability is near the share that is right."""
    truth = SHORT | {t: license_scan.UNKNOWN for t in ORDINARY}
    docs = spark.createDataFrame(list(enumerate(truth)), "doc_id long, text string")
    families = list(truth.values())
    rows = license_scan.scan(docs, licences, least_similarity=0.0).collect()
    right = np.mean([r.family == families[r.doc_id] for r in rows])
    assert len(rows) > len(SHORT) and abs(np.mean([r.probability for r in rows]) - right) < 0.2
