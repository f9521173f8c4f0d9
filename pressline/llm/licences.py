"""Licence scans, in DataFrame operations only: a trained paragraph classifier, confirmed by templates.

Texts are cut at blank lines and at sentence ends. Each line of a sentence is judged, and a sentence of several lines also as a whole, so hard-wrapped
notices are found; a confirmed whole takes the place of its unconfirmed lines, and a whole that says nothing new counts for nothing. These pieces,
called paragraphs here, are bags of word n-grams (one to three words). A sparse multinomial logistic regression knows the n-grams of the
licence templates that hold at least one licence word, and tells the licence families and ordinary text apart. It is trained on the templates,
on their copies with a word left out, and on every distinct paragraph of the corpus that holds a
licence word (equal sets of known n-grams are one weighted row); the latter are labelled by template comparison, and those that hold ``NEAR`` or more of a template, but less than ``CONFIRM``, are left out. A part of these rows is held out to calibrate: a
family is only named above the probability that ``CLEAN`` of the held-out ordinary rows stay below. A named family is confirmed if
the paragraph holds ``CONFIRM`` of the n-grams of one of its templates, among them a word that few other families share, and no word that tells a neighbouring family
(``TELLING``); else the paragraph is of class ``unknown``.

A paragraph without any licence word has no known n-gram, so its score is the constant of the model: it is ordinary, and only the others
are scored. That changes no result.

Per doc_id: family (of the most probable licence paragraph, ties to the smaller name; ``none`` without one), probability, n_paragraphs, confirmed, and families: every family
found, the top one first, with likely (the family that the model names, also where the class is ``unknown``), its largest probability, count and confirmed.
Edge cases: null and empty texts have no paragraph; rows with the same id, or without one, are judged together; repeated paragraphs each
count; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.llm.common import read_table, stage
from pressline.llm.registry import register

# Short notices of common licences, by family, and below the identifiers that stand for them.
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License."],
    "artistic": ["Licensed under the Artistic License 2.0."],
    "boost": ["Distributed under the Boost Software License, Version 1.0."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted.", "Released under the BSD License."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 License."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "Licensed under a Creative Commons Attribution-NoDerivatives 4.0 License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 License."],
    "cc0": ["Dedicated to the public domain under CC0 1.0 Universal."],
    "cddl": ["Licensed under the Common Development and Distribution License."],
    "epl": ["This program is made available under the terms of the Eclipse Public License 2.0."],
    "eupl": ["Licensed under the EUPL, version 1.2."],
    "gfdl": ["Licensed under the GNU Free Documentation License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License."],
    "lgpl": ["Licensed under the GNU Lesser General Public License."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ms-pl": ["Licensed under the Microsoft Public License."],
    "ofl": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "reserved": ["All rights reserved."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "wtfpl": ["Licensed under the WTFPL, version 2."],
    "zlib": ["Released under the zlib License."],
}
IDENTIFIERS = {
    "agpl": "AGPL-3.0-only", "apache": "Apache-2.0", "artistic": "Artistic-2.0", "boost": "BSL-1.0", "bsd": "BSD-3-Clause", "cc-by": "CC-BY-4.0", "cc-by-nc": "CC-BY-NC-4.0",
    "cc-by-nd": "CC-BY-ND-4.0", "cc-by-sa": "CC-BY-SA-4.0", "cc0": "CC0-1.0", "cddl": "CDDL-1.0", "epl": "EPL-2.0", "eupl": "EUPL-1.2", "gfdl": "GFDL-1.3-only", "gpl": "GPL-3.0-only",
    "isc": "ISC", "lgpl": "LGPL-2.1-only", "mit": "MIT", "mpl": "MPL-2.0", "ms-pl": "MS-PL", "ofl": "OFL-1.1", "unlicense": "Unlicense", "wtfpl": "WTFPL", "zlib": "Zlib",
}
for _family, _id in IDENTIFIERS.items():
    TEMPLATES[_family].append(f"SPDX-License-Identifier: {_id}")
# Words that part a family from its neighbours; a paragraph that holds one is of no other family.
TELLING = {"affero": "agpl", "agpl": "agpl", "lesser": "lgpl", "lgpl": "lgpl", "documentation": "gfdl", "gfdl": "gfdl", "sharealike": "cc-by-sa", "sa": "cc-by-sa",
           "noncommercial": "cc-by-nc", "nc": "cc-by-nc", "noderivatives": "cc-by-nd", "nd": "cc-by-nd"}
#: A word of so many families' templates tells none of them.
SHARED = 3
# Fixed value: words of templates that ordinary text has too.
COMMON = ("0 1 2 3 4 a all and available common font for into made any are as by except file form forms free in is it only may not of or person subject terms that the this to under use v with without work you can").split()
TASK_ROWS = 100_000  # training rows of a task
HELD_OUT = 5         # one in so many corpus rows calibrates instead of training
CLEAN = 0.999
CONFIRM = 0.6
NEAR = 0.3           # reworded notices: neither a family's sample nor an ordinary one
PARTED = r"\n[^\p{L}\p{N}\n]*\n|(?<=[\p{Ll}\p{N})][.!?])[^\p{L}\p{N}]+(?=\p{Lu})"
ORDINARY = "none"


def words(text):
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(w):
    """The distinct n-grams of one to three words of an array of words."""
    n = F.size(w)

    def of(k):
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))) \
            .otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def template_grams(spark: SparkSession) -> DataFrame:
    """family, template, gram: the known n-grams of each template."""
    rows = [(family, k, t) for family, texts in TEMPLATES.items() for k, t in enumerate(texts)]
    licence = F.exists(F.split("gram", " "), lambda w: ~w.isin(*COMMON))
    return spark.createDataFrame(rows, "family string, template int, text string") \
        .select("family", "template", F.explode(grams(words(F.col("text")))).alias("gram")).where(licence)


def plain_words(text: str) -> set[str]:
    return set(re.findall(r"[^\W_]+", text.lower())) - set(COMMON)


def rules(spark: SparkSession) -> DataFrame:
    """family, template, own (the words of which a paragraph needs one, if any) and foreign (words that rule the family out)."""
    families: dict[str, set[str]] = {}
    for family, texts in TEMPLATES.items():
        for w in set().union(*map(plain_words, texts)):
            families.setdefault(w, set()).add(family)
    rows = [(family, k, sorted(w for w in plain_words(t) if len(families[w]) < SHARED), sorted(w for w, f in TELLING.items() if f != family))
            for family, texts in TEMPLATES.items() for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "family string, template int, own array<string>, foreign array<string>")


def likeness(held: DataFrame, templates: DataFrame) -> DataFrame:
    """key, family, like: the largest share of the n-grams of one of the family's templates that the row holds; below ``CONFIRM``
    for a template none of whose telling words is there, and for a family that another's telling word rules out. ``held``: key, grams."""
    size = templates.groupBy("family", "template").agg(F.count(F.lit(1)).alias("size"))
    known = F.broadcast(templates.join(size, ["family", "template"]).join(rules(held.sparkSession), ["family", "template"]))         # the fixed templates
    # only the telling words travel with the n-grams; a template's own words are among its n-grams
    telling = F.array_intersect("grams", F.array(*map(F.lit, sorted(TELLING)))).alias("telling")
    per = held.select("key", telling, F.explode("grams").alias("gram")).join(known, "gram") \
        .groupBy("key", "family", "template").agg((F.count(F.lit(1)) / F.first("size")).alias("like"),
                                                  F.bool_or((F.size("own") == 0) | F.array_contains("own", F.col("gram"))).alias("owned"),
                                                  F.bool_or(F.arrays_overlap("telling", "foreign")).alias("ruled_out"))
    told = F.col("owned") & ~F.col("ruled_out")
    like = F.when(told, F.col("like")).otherwise(F.least(F.col("like"), F.lit(CONFIRM - 0.01)))
    return per.groupBy("key", "family").agg(F.max(like).alias("like"))


def named(held: DataFrame, weights: DataFrame, constants: dict[str, float]) -> DataFrame:
    """key, family, probability: the most probable licence family by the sparse model. ``held``: key, grams; ``weights``: gram, family, weight."""
    spark = held.sparkSession
    classes = F.broadcast(spark.createDataFrame(sorted(constants.items()), "family string, constant double"))
    sums = held.select("key", F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram").groupBy("key", "family").agg(F.sum("weight").alias("sum"))
    every = held.select("key", F.explode(F.array(*map(F.lit, sorted(constants)))).alias("family"))
    scores = every.join(sums, ["key", "family"], "left").join(classes, "family") \
        .select("key", "family", (F.col("constant") + F.coalesce("sum", F.lit(0.0))).alias("score"))
    by_key = scores.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("score", "family"))).alias("s"))   # one entry per class
    top = F.element_at("s", -1)["score"]
    total = F.aggregate("s", F.lit(0.0), lambda t, e: t + F.exp(e["score"] - F.element_at("s", -1)["score"]))
    best = F.element_at(F.filter("s", lambda e: e["family"] != ORDINARY), -1)
    return by_key.select("key", best["family"].alias("family"), (F.exp(best["score"] - top) / total).alias("probability"))


def fit(sets: DataFrame, likes: DataFrame, vocabulary: list[str]):
    """Weights (gram, family, weight) and constants of the trained model, and the calibrated limit, from every distinct paragraph.
    ``sets``: key, grams, n_train, n_held (the distinct paragraphs with these n-grams); ``likes``: key, family, like."""
    spark = sets.sparkSession
    vocab = F.array(*map(F.lit, vocabulary))
    notices = spark.createDataFrame([(f, t) for f, texts in TEMPLATES.items() for t in texts], "label string, text string").withColumn("words", words(F.col("text")))
    less = notices.where(F.size("words") > 3).select("label", F.posexplode("words").alias("at", "_"), "words") \
        .select("label", F.filter("words", lambda w, i: i != F.col("at")).alias("words"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    made = notices.select("label", "words").unionByName(less).select(F.lit("").alias("key"), "label", F.array_sort(F.array_intersect(grams(F.col("words")), vocab)).alias("grams"), one.alias("n_train"), none.alias("n_held"))
    tops = likes.groupBy("key").agg(F.max(F.struct("like", "family")).alias("top"))
    seen = sets.join(tops, "key", "left").where(F.coalesce((F.col("top.like") < NEAR) | (F.col("top.like") >= CONFIRM), F.lit(True))).select(
        "key", F.when(F.col("top.like") >= CONFIRM, F.col("top.family")).otherwise(ORDINARY).alias("label"), "grams", "n_train", "n_held")
    empty = spark.createDataFrame([("", ORDINARY, [], 1, 0)], "key string, label string, grams array<string>, n_train long, n_held long")
    names = [ORDINARY, *sorted(TEMPLATES)]
    target = (F.array_position(F.array(*map(F.lit, names)), F.col("label")) - 1).cast("double")
    rows = stage(made.unionByName(seen).unionByName(empty).withColumn("target", target), "licence-train")
    # a fixed order, so that reruns agree; the tasks follow the number of rows
    rows = stage(rows.repartitionByRange(math.ceil(rows.count() / TASK_ROWS), "key", "label", "grams").sortWithinPartitions("key", "label", "grams"), "licence-train")
    # classes weigh the same, however many ordinary paragraphs the corpus has
    learnt = rows.where(F.col("n_train") > 0)
    share = learnt.groupBy("label").agg((F.lit(1.0) / F.sum("n_train")).alias("weigh"))
    learnt = learnt.join(F.broadcast(share), "label", "left").withColumn("weigh", F.coalesce("weigh", F.lit(0.0)) * F.col("n_train") * 100)
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", binary=True)
    model = LogisticRegression(featuresCol="features", labelCol="target", weightCol="weigh", family="multinomial", regParam=1e-3, elasticNetParam=0.2, maxIter=60, standardization=False) \
        .fit(counter.transform(learnt))
    matrix, ahead = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    weights = spark.createDataFrame([(g, n, float(matrix[k, i])) for k, n in enumerate(names[:len(ahead)]) for i, g in enumerate(vocabulary) if matrix[k, i]]
                                    or [("", ORDINARY, 0.0)], "gram string, family string, weight double")
    constants = {n: float(ahead[k]) for k, n in enumerate(names[:len(ahead)])}
    held = rows.where((F.col("n_held") > 0) & (F.col("label") == ORDINARY))
    clean = named(held.select("key", "grams"), weights, constants).join(held.select("key", "n_held"), "key")
    limit = clean.agg(F.percentile("probability", F.lit(CLEAN), F.col("n_held"))).first()[0]
    return weights, constants, max(0.5, float(limit or 0.0))


def scan_licences(docs: DataFrame) -> DataFrame:
    templates = template_grams(docs.sparkSession)
    vocabulary = sorted({r.gram for r in templates.select("gram").collect()})          # of the fixed templates
    licence_words = F.array(*[F.lit(g) for g in vocabulary if " " not in g])
    vocab = F.array(*map(F.lit, vocabulary))
    lines = F.split("sentence", "\n")
    pieces = F.concat(F.transform(lines, lambda t: F.struct(t.alias("text"), F.lit(False).alias("whole"))),
                      F.when(F.size(lines) > 1, F.array(F.struct(F.col("sentence").alias("text"), F.lit(True).alias("whole"))))
                      .otherwise(F.array().cast("array<struct<text:string,whole:boolean>>")))
    parted = docs.select("doc_id", F.explode(F.split("text", PARTED)).alias("sentence")) \
        .select("doc_id", F.md5("sentence").alias("part"), F.explode(pieces).alias("piece")) \
        .withColumn("words", words(F.col("piece.text"))).where(F.arrays_overlap("words", licence_words))
    known = F.array_sort(F.array_intersect(grams(F.col("words")), vocab))
    paragraphs = stage(parted.select("doc_id", "part", "piece.whole", F.md5("piece.text").alias("text_key"), known.alias("grams"))
                       .withColumn("key", F.md5(F.array_join("grams", "\n"))), "licence-paragraphs")
    # a paragraph is judged by its known n-grams alone: each set of them once, with the distinct paragraphs that have it
    held = F.pmod(F.xxhash64("text_key"), F.lit(HELD_OUT)) == 0
    counts = paragraphs.select("key", "text_key").distinct().groupBy("key").agg(F.count_if(~held).alias("n_train"), F.count_if(held).alias("n_held"))
    sets = stage(paragraphs.groupBy("key").agg(F.first("grams").alias("grams")).join(counts, "key"), "licence-sets")
    likes = stage(likeness(sets, templates), "licence-likeness")
    weights, constants, limit = fit(sets, likes, vocabulary)
    found = named(sets, weights, constants).where(F.col("probability") > limit)
    judged = found.join(likes, ["key", "family"], "left").select(
        "key", F.when(F.col("like") >= CONFIRM, F.col("family")).otherwise("unknown").alias("family"), F.col("family").alias("likely"), F.round("probability", 6).alias("probability"),
        F.coalesce(F.col("like") >= CONFIRM, F.lit(False)).alias("confirmed"))
    each = paragraphs.groupBy("doc_id", "part", "key", "whole").agg(F.count(F.lit(1)).alias("n")).join(judged, "key")
    by_part = each.groupBy("doc_id", "part").agg(F.collect_list(F.struct("whole", "family", "likely", "probability", "confirmed", "n")).alias("c"))      # one entry per distinct named line
    single, whole = F.filter("c", lambda e: ~e["whole"]), F.filter("c", lambda e: e["whole"])
    sure = F.filter(single, lambda e: e["confirmed"])
    new = F.exists(whole, lambda e: e["confirmed"] & ~F.array_contains(F.transform(sure, lambda s: s["family"]), e["family"]))
    counted = by_part.select("doc_id", F.explode(F.when(new, F.concat(sure, whole)).when(F.size(single) > 0, single).otherwise(whole)).alias("e")) \
        .select("doc_id", "e.*")
    per_family = counted.groupBy("doc_id", "family", "likely").agg(F.max("probability").alias("probability"), F.sum("n").alias("n"), F.first("confirmed").alias("confirmed"))
    order = F.struct((~F.col("confirmed")).alias("open"), (-F.col("probability")).alias("less"), "family", "likely", "n")
    ranked = F.transform(F.array_sort(F.collect_list(order)), lambda e: F.struct(     # at most two entries per family of the templates
        e["family"].alias("family"), e["likely"].alias("likely"), (-e["less"]).alias("probability"), e["n"].alias("n_paragraphs"), (~e["open"]).alias("confirmed")))
    per_doc = per_family.groupBy(F.col("doc_id").alias("found_id")).agg(ranked.alias("families"), F.sum("n").alias("n_paragraphs"))
    top = F.get("families", F.lit(0))
    return docs.select("doc_id").distinct().join(per_doc, F.col("doc_id").eqNullSafe(F.col("found_id")), "left").select(
        "doc_id", F.coalesce(top["family"], F.lit(ORDINARY)).alias("family"), F.coalesce(top["probability"], F.lit(0.0)).alias("probability"),
        F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce(top["confirmed"], F.lit(False)).alias("confirmed"),
        F.coalesce("families", F.array().cast("array<struct<family:string,likely:string,probability:double,n_paragraphs:bigint,confirmed:boolean>>")).alias("families"))


@register("op9_licences")
def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
