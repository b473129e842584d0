"""Licence scans: a trained paragraph classifier over sparse word n-grams. No Python runs on the executors.

The classifier is asked about sentences of paragraphs (lines) with licence-like wording or a word pair of any notice;
no other sentence can be told as a licence, whatever its probability. Their counts of hashed words and word pairs go to
a multinomial logistic regression, which gives each licence family and the class "none" a probability. It is trained on
sentences of the families' notices below and, as "none", on half of all such sentences of the corpus that hold no two
pairs of notices. The decision level is calibrated on the other half: it is the probability that at most one in
CALIBRATION of its sentences reach. Which half a sentence is in follows from its words. A prediction above it counts once a template confirms it: enough of the sentence's word pairs stand in notices of
that family, or enough of one notice sentence's pairs stand in the sentence, whatever else it says. A notice
sentence that stands whole in the text, or an SPDX line, counts whatever the classifier says of the words around it.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import cut, drop_table

NONE = "none"
FEATURES = 1 << 13
CALIBRATION = 500
#: The level is a multiple of one in LEVELS.
LEVELS = 10_000
#: Weight of a notice in training at least, and of all notices together as a share of the corpus's sentences.
NOTICE, NOTICES_SHARE = 20.0, 0.3
FLOOR, CONFIRMED = 0.5, 0.5
#: Share of a notice sentence's word pairs that a sentence must hold: too many for a sentence that names another licence.
COVERED = 0.8
#: Where a line is divided: after an end of sentence and white space; and what ends a line.
SENTENCE, LINE = r"(?<=[.!?])\s+|(?<=[。！？])", r"\R"
UNKNOWN = "unknown"
#: Wording that makes a sentence above the level licence-like, where no template confirms it.
LICENCE_LIKE = r"licen[cs]e|copyright|spdx|permission|warrant|redistribut|all rights reserved"
#: Words of SPDX identifiers by family.
SPDX = {
    "apache": ("apache",), "bsd": ("bsd", "0bsd"), "cc": ("cc", "cc0"), "epl": ("epl",), "gpl": ("gpl", "lgpl", "agpl"), "isc": ("isc",),
    "mit": ("mit",), "mpl": ("mpl",), "unlicense": ("unlicense",),
}

# Short notices by which public licences are granted or named, by family.
NOTICES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Released under the Apache License 2.0. This project is licensed under the terms of the Apache 2.0 license.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD License. Licensed under the BSD 3-Clause License. This work is licensed under the 2-clause BSD license.",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike license.",
        "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal public domain dedication.",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0.",
        "Licensed under the Eclipse Public License 2.0.", "Released under the EPL 2.0.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Released under the GNU General Public License version 2. Licensed under the GPL v3. Licensed under the GNU Lesser General Public License.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.", "Licensed under the ISC License.",
    ),
    "mit": (
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "Licensed under the Unlicense.",
    ),
}
FAMILIES = (NONE, *sorted(NOTICES))


def _grams(words: str) -> Column:
    """The words of an array column, and each two neighbours with a space between."""
    w = F.col(words)
    return F.concat(w, F.transform(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda b, i: F.concat(F.get(w, i), F.lit(" "), b)))


def _words(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), "^[^a-z0-9]+", "")
    return F.when(plain != "", F.split(plain, "[^a-z0-9]+"))


def _vectors(df: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, inputCol="grams", outputCol="features").transform(df.withColumn("grams", _grams("words")))


def template_grams() -> dict[str, list[str]]:
    """Word pairs of each family's notices: at most a few hundred strings."""
    out = {}
    for family, notices in NOTICES.items():
        pairs = set()
        for n in notices:
            w = re.findall("[a-z0-9]+", n.lower())
            pairs |= {f"{a} {b}" for a, b in zip(w, w[1:])}
        out[family] = sorted(pairs)
    return out


def notice_sentences() -> dict[str, list[str]]:
    """The sentences of each family's notices as lower-cased words with single spaces."""
    parts = lambda n: (" ".join(re.findall("[a-z0-9]+", p.lower())) for p in re.split(r"(?<=[.;]) ", n))
    return {f: sorted({p for n in notices for p in parts(n) if len(p.split()) > 3}) for f, notices in NOTICES.items()}


def _any_of(strings: set[str]) -> str:
    """A pattern of the strings, which share the patterns of their common beginnings."""
    heads: dict[str, set[str]] = {}
    for x in strings:
        heads.setdefault(x[:1], set()).add(x[1:])
    return "(?:" + "|".join(h + _any_of(heads[h]) if h else "" for h in sorted(heads, reverse=True)) + ")"


#: What a lower-cased sentence must hold to be told as a licence: licence-like wording or a word pair of a notice.
ASKED = f"{LICENCE_LIKE}|(?<![a-z0-9]){_any_of({g for v in template_grams().values() for g in v}).replace(' ', '[^a-z0-9]+')}(?![a-z0-9])"


def asked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, at, text, words: the sentences of each row's lines (at, any kind of line end) that the classifier is asked about.

    row tells rows of one id apart. The table is written, as training and scan read it.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("all")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("doc_id", "row", F.posexplode(F.split(F.coalesce("all", F.lit("")), LINE)).alias("at", "line")).filter(F.lower("line").rlike(ASKED))
    rows = rows.select("doc_id", "row", "at", F.explode(F.split("line", SENTENCE)).alias("text")).filter(F.lower("text").rlike(ASKED))
    return cut(rows.withColumn("words", _words(F.col("text"))), "licence-asked")


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per id: doc_id, n_paragraphs, the number of lines that have any word."""
    worded = F.filter(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), LINE), lambda x: F.lower(x).rlike("[a-z0-9]"))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.size(worded).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n_paragraphs"))


def others(found: DataFrame) -> DataFrame:
    """words, half: each sentence of ``asked`` that holds no two word pairs of notices, once.

    Those that hold two are left out, so that the corpus's own notices do not train the class "none".
    """
    pairs = F.array(*map(F.lit, sorted({g for v in template_grams().values() for g in v})))
    own = found.select("words").distinct().filter(F.size(F.array_intersect(_grams("words"), pairs)) < 2)
    return own.withColumn("half", F.pmod(F.xxhash64("words"), F.lit(2)))


def _naming(sentences: dict[str, list[str]]) -> dict[str, list[str]]:
    """The notice sentences that belong to one family alone."""
    every = [p for v in sentences.values() for p in v]
    return {f: [p for p in v if every.count(p) == 1] for f, v in sentences.items()}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None) -> tuple[LogisticRegressionModel, float]:
    """The classifier and its decision level, from all sentences of ``others``: half of them train, half calibrate.

    found is the result of ``asked``, where it is there already.
    """
    spark: SparkSession = docs.sparkSession
    told = cut(others(found or asked(docs, id_col, text_col)), "licence-others")
    negative = told.filter("half = 0")
    known = [(float(FAMILIES.index(f)), part) for f, notices in NOTICES.items() for n in notices for part in sorted({n, *re.split(r"(?<=[.:;]) ", n)}) if len(part.split()) > 2]
    weight = max(NOTICE, NOTICES_SHARE * negative.count() / len(known))  # the balance does not follow the corpus's size
    labelled = spark.createDataFrame(known, "label double, text string").select("label", F.lit(weight).alias("weight"), _words(F.col("text")).alias("words"))
    data = labelled.unionAll(negative.select(F.lit(0.0), F.lit(1.0), "words"))
    model = LogisticRegression(family="multinomial", weightCol="weight", regParam=1e-4, maxIter=40, standardization=False).fit(_vectors(data).select("label", "weight", "features"))
    step = F.floor((1 - vector_to_array("probability")[0]) * LEVELS)
    steps = model.transform(_vectors(told.filter("half = 1"))).groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    level, reach, most = 0, 0, sum(r["n"] for r in steps) / CALIBRATION
    for r in steps:
        if (reach := reach + r["n"]) > most:
            level = (r["step"] + 1) / LEVELS
            break
    drop_table(told)
    return model, max(FLOOR, min(0.99, level))


#: Beginnings of rare words, one of which every notice sentence has.
_RARE = ("licen", "permi", "redistrib", "unlicense", "copyright", "software", "epl", "mpl", "public", "warrant")


def _telling(naming: dict[str, list[str]]) -> list[str]:
    """Words of which every notice sentence and every SPDX line has one; a sentence without them holds none of these."""
    return sorted({"license", *(next(w for w in p.split() if w.startswith(_RARE)) for v in naming.values() for p in v)})


def _covered(pairs: Column, sentences: list[str]) -> Column:
    """Whether enough pairs of one of the sentences stand in the array ``pairs``."""
    out = F.lit(False)
    for w in (p.split() for p in sentences):
        own = sorted({f"{a} {b}" for a, b in zip(w, w[1:])})
        out = out | (F.size(F.array_intersect(pairs, F.array(*map(F.lit, own)))) >= COVERED * len(own))
    return out


def license_scan(docs: DataFrame, model: LogisticRegressionModel, level: float, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None) -> DataFrame:
    """One row per input row id: doc_id, n_paragraphs, n_licences, families, license, score, unconfirmed.

    n_paragraphs counts lines with a word, n_licences those with a confirmed sentence. license is the family of the
    strongest confirmed sentence (ties: by name), without one "unknown" where the text has an unconfirmed line, else
    "none"; families holds all confirmed ones, sorted; unconfirmed counts lines without a confirmed sentence that have
    a licence-like one above the level. A null or empty text has no paragraphs. Rows that share an id are one document.
    found is the result of ``asked``, where it is there already.
    """
    names = F.array(*map(F.lit, FAMILIES))
    templates = F.create_map(*[x for f, g in template_grams().items() for x in (F.lit(f), F.array(*map(F.lit, g)))])
    sentences = notice_sentences()
    lines = _vectors(found or asked(docs, id_col, text_col))
    p = F.col("p")
    scored = model.transform(lines).select("doc_id", F.struct("row", "at").alias("at"), "text", "words", vector_to_array("probability").alias("p"))
    scored = scored.select("doc_id", "at", "text", "words", "p", p[0].alias("none"), F.array_max(F.slice(p, 2, len(FAMILIES) - 1)).alias("best"))
    scored = scored.withColumn("family", F.element_at(names, (F.array_position(F.slice(p, 2, len(FAMILIES) - 1), F.col("best")) + 1).cast("int")))
    sure = (1 - F.col("none") >= level) & (F.col("best") > F.col("none"))
    pairs = F.filter(_grams("words"), lambda g: F.contains(g, F.lit(" ")))
    held = F.size(F.array_intersect(pairs, F.element_at(templates, F.col("family")))) / F.greatest(F.size(F.array_distinct(pairs)), F.lit(1))
    covers = F.lit(False)
    for f, parts in sentences.items():
        covers = F.when(F.col("family") == f, _covered(pairs, parts)).otherwise(covers)
    plain = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    spdx = F.contains(F.col("plain"), F.lit(" spdx license identifier "))
    whole = []
    naming = _naming(sentences)
    for f, parts in naming.items():
        said = spdx & F.arrays_overlap("words", F.array(*map(F.lit, SPDX[f])))
        for part in parts:
            said = said | F.contains(F.col("plain"), F.lit(f" {part} "))
        whole.append(F.when(said, F.lit(f)))
    empty = F.array().cast("array<string>")
    telling = F.arrays_overlap("words", F.array(*map(F.lit, _telling(naming))))
    judged = scored.withColumn("sure", sure).withColumn("plain", F.when(telling, plain)).select(
        "doc_id", "at", "best", "p", (F.col("sure") & F.lower("text").rlike(LICENCE_LIKE)).alias("sure"),
        F.array_union(F.when(F.col("plain").isNotNull(), F.array_compact(F.array(*whole))).otherwise(empty), F.when(F.col("sure") & ((held >= CONFIRMED) | covers), F.array("family")).otherwise(empty)).alias("said"),
    )
    of = lambda f: F.element_at(F.col("p"), F.array_position(names, f).cast("int"))
    confirmed = F.size("said") > 0
    hit = F.when(confirmed, F.array_min(F.transform("said", lambda f: F.struct((-of(f)).alias("p"), f.alias("family")))))
    found = judged.groupBy("doc_id").agg(
        F.collect_set(F.when(confirmed, F.col("at"))).alias("confirmed"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("said")))).alias("families"), F.min(hit).alias("hit"),
        F.collect_set(F.when(F.col("sure"), F.col("at"))).alias("sure"),
    )
    found = found.withColumn("n_licences", F.size("confirmed")).withColumn("unconfirmed", F.size(F.array_except("sure", "confirmed")))
    out = paragraphs(docs, id_col, text_col).join(found.withColumnRenamed("doc_id", "found_id"), F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select(
        F.col("doc_id").alias(id_col), zero("n_paragraphs"), zero("n_licences"), F.concat_ws(",", "families").alias("families"),
        F.coalesce("hit.family", F.when(F.col("unconfirmed") > 0, F.lit(UNKNOWN)), F.lit(NONE)).alias("license"), F.round(F.coalesce(-F.col("hit.p"), F.lit(0.0)), 6).alias("score"), zero("unconfirmed"),
    )
