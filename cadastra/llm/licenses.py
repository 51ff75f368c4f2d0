"""Licence scan by a trained paragraph classifier, with DataFrame functions only.

1. Training rows are variants of known notices (below) and, for the unknown class, other
   sentences with licence words and a bounded sample of corpus paragraphs. Features are the
   one- to three-word n-grams of a paragraph, present or not; a multinomial logistic
   regression with an L1 penalty leaves few weights.
2. On rows held out from the fit, the temperature of the softmax is set to the least log
   loss, and the least probability of a family to what keeps unknown rows out.
3. Paragraphs are single lines and groups of neighbouring lines, so that a notice is found
   however it is wrapped. Those with a licence word that hold at least ``CONFIRM`` of the
   n-grams of a notice are scored by joining their n-grams with the weights, which hold at
   most the n-grams of the training rows. A family counts if its probability reaches the
   threshold and the share is reached by one of the family's notices.
4. Of overlapping groups the one with the largest share (in tenths) counts, then the one
   with fewest lines; lines inside a group that counts are not counted again.

A paragraph without any licence word is unknown by definition. Whole texts are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Short notices of public licences, by family.
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0."),
    ("apache", "Distributed under the Apache 2.0 license."),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("gpl", "Released under the GPL version 2 or later."),
    ("gpl", "Licensed under the GPL."),
    ("gpl", "SPDX-License-Identifier: GPL-2.0-only"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "Released under the AGPL version 3 or later."),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "Licensed under the LGPL."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsl", "Licensed under the BSL 1.1 license."),
    ("bsl", "Use of this software is governed by the Business Source License 1.1."),
    ("isc", "Licensed under the ISC License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("epl", "Licensed under the Eclipse Public License 2.0."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc0", "Dedicated to the public domain under the CC0 1.0 Universal license waiver."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential license."),
]
#: Sentences with licence words that grant nothing, and grants of licences outside the families.
OTHERS = [
    "Licensed under the zlib license.", "Distributed under the Boost Software License, Version 1.0.", "Released under the Artistic License 2.0.", "This font is licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the Common Development and Distribution License.", "Licensed under the European Union Public Licence 1.2.", "This is free and unencumbered software released under the Unlicense.", "Licensed under the terms of the WTFPL.",
    "Released under the PostgreSQL License.", "Licensed under the Microsoft Public License.", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: BSL-1.0",
    "He lost his driving licence on the way home.", "The city council renewed the restaurant's alcohol license last week.", "Human rights groups met the minister.", "A fishing license costs ten dollars.",
    "She has the copyright lawyer's number.", "The apache helicopter landed near the road.", "The warranty covers two years of repairs.", "They fought for equal rights in the workplace.",
    "Permission to enter the building was refused.", "His licence plate was stolen.", "The license fee was raised again by the government.", "A general public meeting will be held in the town hall.",
    "The creative commons room is on the first floor.", "Copyright disputes are common in the music trade.", "The redistribution of wealth was debated.", "The license agreement between the two clubs ended.",
    "Water rights are sold by the river board.", "The Mozilla building is in the old town.", "Version 2.0 of the report was published.", "All seats are reserved for members.",
]
#: What may stand before a notice in training variants.
LEADS = ["", "", "this file is", "copyright 2020 the authors", "note that", "unless stated otherwise", "the code in this folder is"]
CUES = ["licen", "copyright", "all rights", "redistribut", "permission", "creative commons", "public domain", "cc by", "cc0"]
#: Names of licences, which are cues as whole words; with ``CUES`` every notice holds a cue.
NAMES = ["gpl", "lgpl", "agpl", "bsd", "mpl", "epl", "apache", "mozilla", "eclipse"]
#: Names that are words of other languages in small letters.
CAPITALS = ["MIT", "ISC", "BSL"]
VARIANTS, SAMPLE_DOCS, SAMPLE_PARAGRAPHS = 14, 100, 500
CONFIRM = 0.5
#: Penalty of the regression and its L1 share.
PENALTY, L1_SHARE = 0.0005, 0.5


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def ngrams(tokens: str) -> Column:
    """Distinct n-grams of one to three words of an array column."""
    return F.expr(f"""array_distinct(concat({tokens},
        transform(sequence(1, greatest(size({tokens}) - 1, 1)), i -> array_join(slice({tokens}, i, 2), ' ')),
        transform(sequence(1, greatest(size({tokens}) - 2, 1)), i -> array_join(slice({tokens}, i, 3), ' '))))""")


def has_cue(text: Column) -> Column:
    lower = F.lower(text)
    found = F.lit(False)
    for cue in CUES:
        found = found | lower.contains(cue)
    return found


def may_hold(text: Column) -> Column:
    """Whether a text or line has a licence word; of cues of two words, which a line break may part, the last counts."""
    cues = [c.split()[-1] for c in CUES if c != "cc by"]
    return F.lower(text).rlike("|".join([*cues, rf"\b(?:{'|'.join(['cc', *NAMES])})\b"])) | text.rlike(rf"\b(?:{'|'.join(CAPITALS)})\b")


def training_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(family, grams, held): variants of the notices and rows of the unknown class.

    ``docs`` has (id, text). The corpus part is at most ``SAMPLE_PARAGRAPHS`` paragraphs
    without a licence word from the ``SAMPLE_DOCS`` documents with the smallest id hashes.
    """
    notices = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(NOTICES)], "n int, family string, text string")
    leads = F.array(*(F.lit(x) for x in LEADS))
    made = (notices.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
            .withColumn("tokens", words("text"))
            .withColumn("tokens", F.expr("filter(tokens, (w, i) -> k = 0 OR (i * 7 + k * 5) % 13 <> 0 OR size(tokens) <= 4)"))
            .withColumn("tokens", F.concat(words(F.element_at(leads, (F.col("k") % len(LEADS) + 1).cast("int"))), "tokens"))
            .selectExpr("family", "tokens", "(n + k) % 4 = 3 AS held"))
    others = (spark.createDataFrame([(i, t) for i, t in enumerate(OTHERS)], "n int, text string")
              .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
              .withColumn("tokens", F.expr("filter(filter(split(lower(text), '[^a-z0-9]+'), w -> w <> ''), (w, i) -> k = 0 OR (i + k) % 4 <> 0)"))
              .selectExpr("'unknown' AS family", "tokens", "n % 4 = 3 AS held"))
    chosen = docs.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)
    prose = (docs.join(F.broadcast(chosen), "id", "left_semi").select("id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
             .where(~has_cue(F.col("line"))).where("trim(line) <> ''").orderBy(F.xxhash64("id", "p"), "id", "p").limit(SAMPLE_PARAGRAPHS)
             .select(F.lit("unknown").alias("family"), words("line").alias("tokens"), (F.pmod(F.xxhash64("id", "p"), F.lit(4)) == 3).alias("held")))
    rows = made.unionByName(others).unionByName(prose).where("size(tokens) > 0")
    return rows.select("family", ngrams("tokens").alias("grams"), "held")


class Model:
    """Sparse weights and the calibration.

    ``weights`` (gram, w array) and ``notices`` (gram, notice, family, size) are bounded by the
    training rows, not by the corpus.
    """

    def __init__(self, families: list[str], bias: list[float], weights: DataFrame, notices: DataFrame, temperature: float, least: float):
        self.families, self.bias, self.weights, self.notices, self.temperature, self.least = families, bias, weights, notices, temperature, least


def train(spark: SparkSession, docs: DataFrame) -> Model:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, StringIndexer

    rows = training_rows(spark, docs).coalesce(1).cache()  # a few hundred rows
    fit = rows.where("NOT held")
    counted = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0, vocabSize=1 << 15).fit(fit)
    indexed = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    fitted = LogisticRegression(maxIter=100, regParam=PENALTY, elasticNetParam=L1_SHARE, family="multinomial", standardization=False).fit(indexed.transform(counted.transform(fit)))
    families, matrix = list(indexed.labels), fitted.coefficientMatrix.toArray()
    kept = [(g, [float(x) for x in matrix[:, i]]) for i, g in enumerate(counted.vocabulary) if abs(matrix[:, i]).max() > 1e-9]
    weights = spark.createDataFrame(kept, "gram string, w array<double>")
    bias = [float(b) for b in fitted.interceptVector.toArray()]
    notices = (spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(NOTICES)], "notice int, family string, text string")
               .withColumn("tokens", words("text")).withColumn("grams", ngrams("tokens"))
               .select("notice", "family", F.size("grams").alias("size"), F.explode("grams").alias("gram")))
    # calibration on the held rows: temperature by log loss, then the least probability
    held = (rows.where("held").withColumn("row", F.monotonically_increasing_id()))
    logits = scores(held, ["row", "family"], "grams", weights, bias)
    tried = (logits.withColumn("t", F.explode(F.array(*(F.lit(x / 4) for x in range(1, 17)))))
             .withColumn("p", softmax("z", "t")).withColumn("own", F.element_at("p", F.array_position(F.array(*(F.lit(f) for f in families)), F.col("family")).cast("int"))))
    losses = {r["t"]: r["loss"] for r in tried.groupBy("t").agg(F.avg(-F.log(F.greatest("own", F.lit(1e-12)))).alias("loss")).collect()}
    temperature = min(losses, key=lambda t: (round(losses[t], 9), t))
    best = logits.withColumn("p", softmax("z", F.lit(temperature))).withColumn("most", F.array_max(_families_only("p", families)))
    floor = best.where("family = 'unknown'").agg(F.percentile("most", 0.99)).first()[0]
    rows.unpersist()
    return Model(families, bias, weights, notices, temperature, max(0.5, floor or 0.0))


def _families_only(p: str, families: list[str]) -> Column:
    return F.filter(p, lambda x, i: i != families.index("unknown"))


def softmax(z: str, t: Column | str) -> Column:
    t = F.col(t) if isinstance(t, str) else t
    shifted = F.transform(z, lambda x: F.exp((x - F.array_max(z)) / t))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def scores(rows: DataFrame, keys: list[str], grams: str, weights: DataFrame, bias: list[float]) -> DataFrame:
    """(keys, z): the logits per class of each row."""
    n = len(bias)
    hits = rows.select(*keys, F.explode(grams).alias("gram")).join(F.broadcast(weights), "gram")  # bounded by the training rows
    sums = hits.groupBy(*keys).agg(*(F.sum(F.col("w")[i]).alias(f"_z{i}") for i in range(n)))
    every = rows.select(*keys).join(sums, keys, "left") if "row" in keys else sums
    return every.select(*keys, F.array(*(F.coalesce(F.col(f"_z{i}"), F.lit(0.0)) + F.lit(b) for i, b in enumerate(bias))).alias("z"))


def _notice_parts() -> list[tuple[list[str], list[str], int]]:
    """Distinct words and n-grams of each notice, and how many of its words hold ``CONFIRM`` of the n-grams at least.

    ``h`` words of a notice hold at most ``3h - 3`` of its n-grams (``h`` if ``h`` is 1).
    """
    out = []
    for _, text in NOTICES:
        tokens = re.findall("[a-z0-9]+", text.lower())
        grams = {" ".join(tokens[i:i + k]) for k in (1, 2, 3) for i in range(len(tokens) - k + 1)}
        held = next(h for h in range(1, len(tokens) + 1) if max(h, 3 * h - 3) >= CONFIRM * len(grams))
        out.append((sorted(set(tokens)), sorted(grams), max(1, held - len(tokens) + len(set(tokens)))))
    return out


def _strings(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def groups(docs: DataFrame) -> DataFrame:
    """(key, p, last, grams) of the lines and groups of lines that hold a licence word and ``CONFIRM`` of a notice; ``docs`` has (key, text).

    A group starts at any line and ends at any later one with fewer words between them than
    the longest notice has, which covers every way of wrapping it. Lines without words are
    passed over. A group that holds no larger share (in tenths) than one of its lines is left out.
    """
    parts = _notice_parts()
    longest = max(len(re.findall("[a-z0-9]+", t.lower())) for _, t in NOTICES)
    enough = " OR ".join(f"size(array_intersect(tokens, {_strings(w)})) >= {k}" for w, _, k in parts)
    share = "greatest(" + ", ".join(f"size(array_intersect(grams, {_strings(g)})) / {len(g)}" for _, g, _ in parts) + ")"
    lines = (docs.where(may_hold(F.col("text")))
             .withColumn("lines", F.filter(F.transform(F.split("text", "\n"), lambda x, p: F.struct(p.alias("p"), may_hold(x).alias("cue"), words(x).alias("t"))),
                                           lambda x: F.size(x["t"]) > 0)))
    # a line starts a group only if a licence word is near enough
    windows = (lines.withColumn("starts", F.expr(f"filter(sequence(1, size(lines)), i -> size(lines) > 0 AND exists(slice(lines, i, {longest + 1}), x -> x.cue))"))
               .select("key", F.explode(F.expr(f"transform(starts, i -> slice(lines, i, {longest + 1}))")).alias("w")))
    sized = windows.withColumn("ends", F.expr(f"""filter(sequence(1, size(w)), j -> exists(slice(w, 1, j), x -> x.cue)
        AND (j <= 2 OR aggregate(slice(w, 2, greatest(j - 2, 0)), 0, (n, x) -> n + size(x.t)) < {longest}))"""))
    every = (sized.select("key", F.explode(F.expr("transform(ends, j -> named_struct('p', w[0].p, 'last', w[j - 1].p, 'tokens', flatten(transform(slice(w, 1, j), x -> x.t))))")).alias("g"))
             .select("key", "g.p", "g.last", "g.tokens").where(enough)
             .withColumn("grams", ngrams("tokens")).withColumn("tenths", F.expr(f"{share}")).where(F.col("tenths") >= CONFIRM)
             .withColumn("tenths", F.round("tenths", 1)))
    # groups of one document, which are few: those that hold a notice's share; a set, as rows may repeat
    listed = every.groupBy("key").agg(F.collect_set(F.struct("p", "last", "tenths", "grams")).alias("all"))
    return (listed.withColumn("single", F.expr("map_from_entries(transform(filter(all, x -> x.p = x.last), x -> struct(x.p, x.tenths)))"))
            .select("key", F.explode(F.expr("""filter(all, x -> x.p = x.last OR NOT exists(sequence(x.p, x.last), i -> coalesce(single[i] >= x.tenths, false)))""")).alias("g"))
            .select("key", "g.*"))


def paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """(key, p, last, family, probability, notice) of each paragraph that a family is found in; ``docs`` has (key, text).

    ``p`` and ``last`` count the lines of the text from 0.
    """
    lines, keys = groups(docs), ["key", "p", "last"]
    families = F.array(*(F.lit(f) for f in model.families))
    best = (scores(lines, keys, "grams", model.weights, model.bias)
            .withColumn("prob", softmax("z", F.lit(model.temperature)))
            .withColumn("probability", F.array_max(_families_only("prob", model.families)))
            .where(F.col("probability") >= model.least)
            .withColumn("family", F.element_at(families, F.array_position("prob", F.col("probability")).cast("int"))))
    alike = (lines.select(*keys, F.explode("grams").alias("gram")).join(F.broadcast(model.notices), "gram")
             .groupBy(*keys, "family", "notice").agg((F.count("*") / F.max("size")).alias("share")).where(F.col("share") >= CONFIRM)
             .groupBy(*keys, "family").agg(F.max_by("notice", F.struct("share", -F.col("notice"))).alias("notice"), F.max("share").alias("share")))
    found = best.join(alike, [*keys, "family"]).select("key", F.struct((-F.round("share", 1)).alias("rank"), (F.col("last") - F.col("p")).alias("more"), "p", "last", "family", "probability", "notice").alias("g"))
    # single lines never overlap; groups count in order of their share unless they overlap one that counts
    order = (found.groupBy("key").agg(F.array_sort(F.collect_list("g")).alias("all"))
             .withColumn("many", F.expr("""aggregate(filter(all, x -> x.more > 0), filter(all, x -> false),
                 (kept, x) -> if(exists(kept, k -> k.p <= x.last AND x.p <= k.last), kept, concat(kept, array(x))))"""))
             .select("key", F.explode(F.expr("concat(many, filter(all, x -> x.more = 0 AND NOT exists(many, k -> k.p <= x.p AND x.p <= k.last)))")).alias("g")))
    return order.select("key", "g.p", "g.last", "g.family", "g.probability", "g.notice")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: Model | None = None) -> DataFrame:
    """One row per document: number of licence paragraphs, distinct families and the places.

    ``families`` lists the distinct families in alphabetical order, ``places`` the pairs
    ``line:family`` in order of lines. Null and empty texts have none. Repeated rows get the
    same result each; rows that share an id but not the text get their own. A null id is an
    id like any other, an empty table gives an empty result, other columns are not read.
    """
    lean = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    model = model or train(docs.sparkSession, lean)
    keyed = lean.select(F.struct("id", F.xxhash64("text").alias("h")).alias("key"), "text")
    found = paragraphs(keyed, model)
    listed = (found.groupBy("key").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("family")).alias("families"),
                                       F.array_sort(F.collect_list(F.struct("p", "family"))).alias("places")))
    out = keyed.select("key.id", "key.h").join(listed.select(F.col("key.id").alias("_id"), F.col("key.h").alias("_h"), "n", "families", "places"),
                                               F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_paragraphs"),
                      F.coalesce(F.array_join("families", ","), F.lit("")).alias("families"),
                      F.coalesce(F.array_join(F.transform("places", lambda x: F.concat_ws(":", x["p"].cast("string"), x["family"])), ","), F.lit("")).alias("places"))
