"""Operator 3: licence scan with a trained paragraph classifier.

A paragraph is a line of a text. Its features are word n-grams (1 to 3 words) that hold at
least one marker: a word of the templates that is no common word. A paragraph without a
marker has no features and is unknown by definition, so it is passed over. A multinomial
logistic regression on hashed features gives the family. It learns from the templates,
from shortened templates, from notices that name no licence, and from the lines of the whole
corpus without licence words whose hash is even, which stand for the unknown class with
a weight of at most ``UNKNOWN_WEIGHT`` together. A family counts only above a threshold that
``1 - FALSE_SHARE`` of the other half of those lines, whose hash is odd, do not exceed. Equal
lines are one row with a count, and lines without a marker, which have no features, are only
counted. A prediction is confirmed when word pairs of the paragraph, or of some part of it as
long as the template, and of a template of that family agree by ``CONFIRM`` (Jaccard), so a notice within a longer line counts as well.

Only built-in functions and Spark's own classifier are used, all of it in the JVM.

Defined cases: null and empty texts have no paragraphs; repeated rows are reported each;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import store
from .lines import text_lines
from .registry import query, table

#: What all lines of the corpus together weigh in training; an example weighs 1.
UNKNOWN_WEIGHT = 1000
#: Parts of a range that a threshold is looked for in, and times they are parted again: 2^-48 in all.
QUANTILE_PARTS, QUANTILE_ROUNDS = 4096, 4
FALSE_SHARE = 0.01
CONFIRM = 0.5
UNKNOWN = "unknown"

#: Short notices by family, in the usual wording.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license.",
        "Licensed under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}

#: Notices of the unknown class that share words with the templates.
OTHER = (
    "All rights reserved.", "Copyright by the author. All rights reserved.",
    "This software is proprietary and confidential.", "Licensed under a commercial license agreement.",
    "A driving license is needed in every state.", "The library is open to the general public.",
    "The foundation granted the permission.", "The work was released last year.",
    "The source of this file is not known.", "Version 2.0 of the program was released.",
    "Use is subject to the terms of service.", "The project has a license of its own.",
    "Redistribution is not permitted.", "See the license file for the terms.",
)

#: Common words, which alone mark nothing.
COMMON = set(
    "a all and any are as be by can copy except extent file files following for form forms free has in is it "
    "last law may met not of on or or-later other permitted person possible provided related rights that the "
    "this to under use used v version with without work works you".split()
)


def _words(text: str) -> list[str]:
    import re

    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


MARKERS = sorted({
    w for notices in TEMPLATES.values() for text in notices for w in _words(text)
    if w not in COMMON and not w.isdigit() and (len(w) > 2 or w == "cc")
})
_LICENCE_WORDS = r"(?i)licen[cs]e|copyright|spdx"
_MARKED = r"(?i)(?<![a-z0-9])(?:" + "|".join(MARKERS) + r")(?![a-z0-9])"


def words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+", -1), lambda w: w != "")


def _grams(tokens: Column, width: int) -> Column:
    last = F.size(tokens) - width + 1
    return F.when(
        last > 0,
        F.transform(F.sequence(F.lit(1), last), lambda i: F.concat_ws(" ", F.slice(tokens, i, width))),
    ).otherwise(F.array().cast("array<string>"))


def features(tokens: Column) -> Column:
    grams = F.concat(*[_grams(tokens, width) for width in (1, 2, 3)])
    return F.filter(grams, lambda gram: gram.rlike(_MARKED))


def _examples(spark: SparkSession) -> DataFrame:
    rows = []
    for family, notices in TEMPLATES.items():
        for text in notices:
            tokens = text.split()
            rows += [(family, text)] * 2
            if len(tokens) > 8:  # a notice cut short still names its licence at one end
                rows += [(family, " ".join(tokens[: 3 * len(tokens) // 4]))]
    rows += [(UNKNOWN, text) for text in OTHER] * 3
    return spark.createDataFrame(rows, "family string, line string")


def marked_lines(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``(*keep, paragraph, line)``: the lines that hold a marker."""
    return docs.filter(F.col(text).rlike(_MARKED)).select(
        *keep, F.posexplode(text_lines(F.col(text))).alias("paragraph", "line")
    ).filter(F.col("line").rlike(_MARKED))


def corpus_lines(docs: DataFrame, marked: DataFrame, *, text: str = "text") -> DataFrame:
    """``(line, half, n)``: how often each marked line without licence words stands in the corpus.

    Each half (0 or 1, by the hash of a line) has an empty line for all lines without a marker.
    """

    def plain(lines: DataFrame) -> DataFrame:
        known = lines.filter((F.length("line") > 0) & ~F.col("line").rlike(_LICENCE_WORDS))
        return known.withColumn("half", F.abs(F.xxhash64("line") % 2).cast("int"))

    counted = store(plain(marked.select("line")).groupBy("line", "half").agg(F.count("*").alias("n")), "licence-lines")
    every = plain(docs.select(F.explode(text_lines(F.col(text))).alias("line")))
    rest = every.groupBy("half").agg(F.count("*").alias("n")).unionByName(
        counted.select("half", (-F.col("n")).alias("n"))
    ).groupBy("half").agg(F.sum("n").alias("n")).filter(F.col("n") > 0)
    return counted.unionByName(store(rest.select(F.lit("").alias("line"), "half", "n"), "licence-rest"))


def weighted_quantile(rows: DataFrame, share: float) -> float | None:
    """The smallest ``probability`` not below ``share`` of the rows, each of which stands for ``n``.

    Counts by part of a range come to the driver, then those by part of the part that
    holds the value, so no task has all values.
    """
    low, width, left = 0.0, 1.0, None
    for _ in range(QUANTILE_ROUNDS):
        below = F.col("probability") < low + width if low + width < 1.0 else F.lit(True)  # 1 itself is in the last part
        inside = rows.filter((F.col("probability") >= low) & below)
        width /= QUANTILE_PARTS
        part = F.least(F.floor((F.col("probability") - low) / width), F.lit(QUANTILE_PARTS - 1)).alias("part")
        counts = inside.groupBy(part).agg(F.sum("n").alias("n"), F.max("probability").alias("most")).orderBy("part").collect()
        if not counts:
            return None
        if left is None:
            left = share * sum(row["n"] for row in counts)
        for row in counts:
            if row["n"] >= left or row is counts[-1]:
                break
            left -= row["n"]
        low += row["part"] * width
    return row["most"]


class LicenceModel:
    """The classifier, its families by index, and the threshold of the unknown class."""

    def __init__(self, model: LogisticRegressionModel, families: list[str], threshold: float):
        self.model, self.families, self.threshold = model, families, threshold

    @staticmethod
    def _hashed(rows: DataFrame) -> DataFrame:
        tokens = rows.withColumn("_tokens", words(F.col("line"))).withColumn("_grams", features(F.col("_tokens")))
        return HashingTF(numFeatures=1 << 13, binary=True, inputCol="_grams", outputCol="features").transform(tokens)

    @classmethod
    def fit(cls, docs: DataFrame, *, text: str = "text", marked: DataFrame | None = None) -> LicenceModel:
        """``marked`` are the marked lines of ``docs``, where they are at hand."""
        families = [UNKNOWN, *sorted(TEMPLATES)]
        lines = corpus_lines(docs, marked_lines(docs, text=text) if marked is None else marked, text=text)
        learnt = lines.filter("half = 0")
        total = learnt.agg(F.sum("n")).first()[0] or 0
        weight = F.col("n") * F.lit(min(1.0, UNKNOWN_WEIGHT / max(1, total)))
        learn = _examples(docs.sparkSession).withColumn("weight", F.lit(1.0)).unionByName(
            learnt.select(F.lit(UNKNOWN).alias("family"), "line", weight.alias("weight"))
        )
        number = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
        ready = cls._hashed(learn.withColumn("label", number.cast("double"))).select("label", "weight", "features").persist()
        model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60, weightCol="weight").fit(ready)
        ready.unpersist()
        scored = cls(model, families, 0.0).score(lines.filter("half = 1").select("line", "n"))
        high = weighted_quantile(store(scored.select("probability", "n"), "licence-scores"), 1 - FALSE_SHARE)
        return cls(model, families, min(0.95, max(0.5, high or 0.0)))

    def score(self, rows: DataFrame) -> DataFrame:
        """Rows with ``line``: the likeliest family and its probability, before the threshold."""
        found = self.model.transform(self._hashed(rows)).withColumn("_p", vector_to_array("probability"))
        known = F.slice("_p", 2, len(self.families) - 1)
        best = F.array_max(known)
        names = F.array(*[F.lit(f) for f in self.families[1:]])
        return found.withColumn("_best", best).withColumn(
            "family", names[F.array_position(known, F.col("_best")).cast("int") - 1]
        ).drop("probability", "rawPrediction", "prediction", "features", "_grams", "_p").withColumnRenamed(
            "_best", "probability"
        )


def scan_licences(docs: DataFrame, *, text: str = "text", model: LicenceModel | None = None) -> DataFrame:
    """``(doc_id, paragraph, family, probability, template, similarity, confirmed)``.

    A row for every paragraph with a marker; ``family`` is unknown below the threshold.
    """
    spark = docs.sparkSession
    lines = marked_lines(docs, "doc_id", text=text)
    if model is None:
        lines = store(lines, "marked-lines")
        model = LicenceModel.fit(docs, text=text, marked=lines)
    scored = model.score(lines)
    templates = spark.createDataFrame(
        [(family, i, text_) for family, notices in TEMPLATES.items() for i, text_ in enumerate(notices)],
        "_family string, _number int, _text string",
    ).withColumn("_pairs", F.array_distinct(_grams(words(F.col("_text")), 2))).groupBy("_family").agg(
        F.sort_array(F.collect_list(F.struct("_number", "_pairs"))).alias("_templates")  # a few per family
    )
    pairs = _grams(F.col("_tokens"), 2)

    def agreement(template: Column) -> Column:
        def jaccard(part: Column) -> Column:
            both = F.size(F.array_intersect(part, template["_pairs"]))
            return both / F.size(F.array_union(part, template["_pairs"]))

        # the best part begins with a pair of the template
        begins = F.filter(
            F.transform("_own", lambda pair, i: F.when(F.array_contains(template["_pairs"], pair), i + 1)),
            lambda i: i.isNotNull(),
        )
        parts = F.transform(begins, lambda i: jaccard(F.slice("_own", i, F.size(template["_pairs"]))))
        return F.struct(
            F.greatest(jaccard(F.col("_own")), F.array_max(parts)).alias("similarity"),
            (-template["_number"]).alias("number"),
        )

    compared = scored.join(F.broadcast(templates), F.col("family") == F.col("_family")).withColumn(
        "_own", pairs
    ).withColumn("_match", F.array_max(F.transform("_templates", agreement)))
    sure = F.col("probability") >= model.threshold
    return compared.select(
        "doc_id", "paragraph", F.when(sure, F.col("family")).otherwise(UNKNOWN).alias("family"),
        F.round("probability", 6).alias("probability"),
        (-F.col("_match.number")).alias("template"),
        F.round("_match.similarity", 6).alias("similarity"),
        (sure & (F.col("_match.similarity") >= CONFIRM)).alias("confirmed"),
    )


@query("op3_licence_scan")
def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
