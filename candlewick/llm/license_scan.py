"""Licence scan: trained paragraph classifier with template confirmation.

A paragraph is a line of a document.  Its words (letters and digits, lower
case) and word pairs that occur in the vocabulary are the binary features of a
multinomial logistic regression over licence families and a *none* class.  The
vocabulary are the words of the templates that ordinary paragraphs hardly use,
and pairs with such a word; a paragraph without any of these words has no
feature at all, is *none* for certain and is left out before scoring.

Training rows are the templates, cut and thinned in fixed ways, and a bounded
sample of the corpus's own paragraphs for *none* (``sample`` rows by hash
order; paragraphs that resemble a template are not taken).  Three folds
calibrate the least probability at which a family is believed: each leaves out
a third of the families whole, whose notices must come out as *unknown*, and one
whole notice of every other family, which must keep its name.  The threshold is
the one with the best mean of both shares.  What is licence-like but below
it, or holds no word or pair that only its family's templates have, is the
*unknown* class.  A prediction is confirmed when its paragraph also shares
enough word pairs with a template of that family.

Scoring runs over every paragraph, as DataFrame expressions and Spark ML
transformers only.

Defined cases: null and empty texts have no paragraphs; very long lines are one
paragraph; repeated rows are classified one by one; a null doc_id stays null;
an empty table trains on templates alone and gives no rows; where ordinary
paragraphs hold every word of the templates nothing tells a licence and no row
is returned; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Short notices of public licences, by family.
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
             "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "apache": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
               "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Content is available under the Creative Commons Attribution License."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "Available under CC BY-NC-SA 4.0 for noncommercial use only."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal, public domain dedication.", "This work is dedicated to the public domain under CC0."],
    "gpl": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
            "This work is licensed under the GNU General Public License, version 3.", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
            "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
             "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
            "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Copyright, all rights reserved. No part of this publication may be reproduced or distributed without prior written permission.",
                    "This document is confidential and proprietary, unauthorized copying is strictly prohibited."],
}
NONE = "none"
FAMILIES = [NONE, *TEMPLATES]
WORDS = r"[^\p{L}\p{N}]+"
SAMPLE = 4000
CONFIRM = 0.5
FOLDS = 3
COMMON = 0.005  # a word in more than this share of sampled paragraphs tells nothing


def _words(text: str) -> list[str]:
    return [w for w in re.sub(r"[^\w]+|_", " ", text.lower()).split(" ") if w]


def _pairs(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def variants(text: str) -> list[str]:
    """A template, its halves and thinned forms, in a fixed order."""
    words = text.split()
    out = [text, text.upper(), f"Copyright (c) 2020 The Authors. {text}", f"{text} See the LICENSE file."]
    if len(words) > 8:
        half = len(words) // 2
        out += [" ".join(words[:half]), " ".join(words[half:]), " ".join(words[half // 2:half + half // 2])]
    for k in range(4, 8):
        thin = [w for i, w in enumerate(words) if (i + 1) % k]
        if len(thin) >= min(4, len(words)):
            out.append(" ".join(thin))
    return out


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (line number), words of every line that has words."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    words = F.filter(F.split(F.regexp_replace(F.lower("line"), WORDS, " "), " "), lambda w: w != "")
    return lines.select("doc_id", "paragraph", words.alias("words")).where(F.size("words") > 0)


def _with_pairs(words: str = "words") -> Column:
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1),
                                                 lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return pairs


@dataclass
class LicenseModel:
    telling: list[str]  # vocabulary words
    features: CountVectorizerModel | None
    regression: LogisticRegressionModel | None
    believed: float  # least probability of a family
    templates: DataFrame  # family, template_pairs
    own: dict[str, list[str]]  # vocabulary grams that one family's templates alone hold
    known_kept: float  # share of left-out notices that keep their family at that probability
    unknown_found: float  # share of left-out families' notices that come out as unknown


def _literal(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def template_pairs(spark: SparkSession) -> DataFrame:
    rows = [(family, sorted(set(_pairs(_words(t))))) for family, texts in TEMPLATES.items() for t in texts]
    return spark.createDataFrame(rows, "family string, template_pairs array<string>")


def train(docs: DataFrame, sample: int = SAMPLE) -> LicenseModel:
    spark = docs.sparkSession
    known = {w for texts in TEMPLATES.values() for t in texts for w in _words(t)}
    # ordinary paragraphs: documents by hash order, then their paragraphs by hash order
    # (ids first: the texts of the others never leave their partitions)
    ids = docs.where("text IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    some = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    plain = paragraphs(some).orderBy(F.xxhash64("doc_id", "paragraph"), "doc_id", "paragraph").limit(sample)
    plain = plain.withColumn("pairs", F.array_distinct(_with_pairs()))
    every = sorted({p for texts in TEMPLATES.values() for t in texts for p in _pairs(_words(t))})
    plain = plain.withColumn("pairs", F.array_intersect("pairs", _literal(every))).where(F.size("pairs") < 2)
    plain = plain.select(F.array_intersect("words", _literal(sorted(known))).alias("words"), "pairs")
    # at most ``sample`` paragraphs, each whole, as those of its grams that templates hold (no other is a feature)
    rows = sorted((r["words"], r["pairs"]) for r in plain.collect())
    seen: dict[str, int] = {}
    for words, _ in rows:
        for w in words:
            seen[w] = seen.get(w, 0) + 1
    telling = sorted(w for w in known if len(w) > 1 and not w.isdigit() and seen.get(w, 0) <= COMMON * max(len(rows), 1))
    keep = set(telling)
    pairs = sorted({p for texts in TEMPLATES.values() for t in texts for p in _pairs(_words(t)) if keep & set(p.split(" "))})
    templates = template_pairs(spark)
    if not telling:
        return LicenseModel([], None, None, 1.0, templates, {}, 0.0, 0.0)
    features = CountVectorizerModel.from_vocabulary(telling + pairs, inputCol="grams", outputCol="features")
    features.setBinary(True)
    vocabulary = {*telling, *pairs}
    notices = {family: [[[*words, *_pairs(words)] for words in map(_words, variants(t))] for t in texts] for family, texts in TEMPLATES.items()}
    plain_grams = [[*words, *two] for words, two in rows]

    def fitted(kept: dict[str, list]) -> LogisticRegressionModel:
        data = [(0, 100.0, [])]  # no feature: none
        for k, family in enumerate(FAMILIES):
            made = plain_grams if k == 0 else [grams for forms in kept.get(family, ()) for grams in forms]
            # none rows weigh as much as all families together
            weight = (len(kept) if k == 0 else 1.0) / max(1, len(made))
            data += [(k, weight * 100, grams) for grams in made]
        frame = spark.createDataFrame(data, "label int, weight double, grams array<string>").coalesce(1)
        return LogisticRegression(featuresCol="features", weightCol="weight", family="multinomial", regParam=1e-3, maxIter=60,
                                  standardization=False).fit(features.transform(frame))

    judged = []  # (held-out row's family is known, its probability where the guess is right or its family unknown)
    for fold in range(FOLDS):
        kept = {f: [x for i, x in enumerate(forms) if len(forms) == 1 or i != fold % len(forms)] for j, (f, forms) in enumerate(notices.items()) if j % FOLDS != fold}
        held = [(f if f in kept else None, grams) for f, forms in notices.items() for i, x in enumerate(forms)
                if f not in kept or (len(forms) > 1 and i == fold % len(forms)) for grams in x]
        own = own_grams(kept, vocabulary)
        frame = spark.createDataFrame([(i, 0.0, grams) for i, (_, grams) in enumerate(held, 1)], "label int, weight double, grams array<string>").coalesce(1)
        scored = fitted(kept).transform(features.transform(frame)).select("label", vector_to_array("probability").alias("p"))
        for i, p in scored.collect():  # forms of the templates: a fixed number of rows
            family, grams = held[i - 1]
            best = max(range(1, len(p)), key=p.__getitem__)
            told = p[0] < 0.5 and bool(set(own.get(FAMILIES[best], ())) & set(grams))
            judged.append((family is not None, p[best] if told and family in (None, FAMILIES[best]) else 0.0))
    known, unknown = ([p for is_known, p in judged if is_known == kind] for kind in (True, False))

    def shares(least: float) -> tuple[float, float]:
        return sum(p >= least for p in known) / len(known), sum(p < least for p in unknown) / len(unknown)

    believed = max(sorted({p for _, p in judged if p > 0} | {0.5}), key=lambda t: sum(shares(t)))
    return LicenseModel(telling, features, fitted(notices), believed, templates, own_grams(notices, vocabulary), *shares(believed))


def own_grams(notices: dict[str, list], vocabulary: set[str]) -> dict[str, list[str]]:
    """The vocabulary grams that the notices of one family alone hold."""
    # the first form of a notice is its text; thinned forms join words that do not stand together
    held = {f: {g for forms in texts for g in forms[0]} & vocabulary for f, texts in notices.items()}
    return {f: sorted(g for g in grams if not any(g in other for name, other in held.items() if name != f)) for f, grams in held.items()}


def classify(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """doc_id, paragraph, family (or unknown), probability, similarity and
    confirmed of every licence-like paragraph."""
    if model.features is None:
        return docs.where(F.lit(False)).select("doc_id", F.lit(0).alias("paragraph"), F.lit("").alias("family"), F.lit("").alias("guess"),
                                               F.lit(0.0).alias("probability"), F.lit(0.0).alias("similarity"), F.lit(False).alias("confirmed"))
    lines = paragraphs(docs).where(F.arrays_overlap("words", _literal(model.telling)))
    lines = lines.withColumn("pairs", _with_pairs()).withColumn("grams", F.concat("words", "pairs"))
    scored = model.regression.transform(model.features.transform(lines)).withColumn("p", vector_to_array("probability"))
    scored = scored.where(F.col("p")[0] < 0.5)
    families = F.slice("p", 2, len(FAMILIES) - 1)
    scored = scored.withColumn("probability", F.array_max(families))
    scored = scored.withColumn("guess", F.element_at(_literal(FAMILIES[1:]), F.array_position(families, F.col("probability")).cast("int")))
    held = model.templates.groupBy("family").agg(F.collect_list("template_pairs").alias("held"))  # a row per family, at most five templates each
    own = docs.sparkSession.createDataFrame(sorted(model.own.items()), "family string, own array<string>")
    held = held.join(F.broadcast(own), "family")
    scored = scored.join(F.broadcast(held), scored["guess"] == held["family"], "left").drop("family")
    distinct = F.size(F.array_distinct("pairs"))
    best = F.array_max(F.transform("held", lambda t: F.size(F.array_intersect("pairs", t)) / F.greatest(F.lit(1), F.least(distinct, F.size(t)))))
    believed = (F.col("probability") >= model.believed) & F.arrays_overlap("grams", "own")
    return scored.select("doc_id", "paragraph", F.when(believed, F.col("guess")).otherwise("unknown").alias("family"), "guess",
                         F.round("probability", 4).alias("probability"), F.round(best, 4).alias("similarity"),
                         (believed & (best >= CONFIRM)).alias("confirmed"))


def scan(docs: DataFrame, **options) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return classify(docs, train(docs, **options))
