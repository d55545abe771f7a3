"""License scans by diagonal voting. Native SQL throughout.

Every rolling gram of GRAM words of every text is joined by hash to the places where templates have it.
A place votes for the diagonal (its offset in the text less that in the template); neighbouring diagonals
of a template are one span if words were put in or left out in between; a span is verified by the share
of the template's words that stand in it, word for word, and by its length.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, scratch, small, written

GRAM = 3
#: Templates of so many words may be found in part: this share of their words must stand in a span, which is longer by a quarter at most.
LONG = 16
SHARE = 0.8

# Phrases whose every place counts, with their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Phrases and notices that only add labels.
NOTICES = [
    ("mit", "SPDX License Identifier MIT"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "SPDX License Identifier Apache 2 0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "under the BSD license"),
    ("cc-by", "Creative Commons Attribution 4 0 International"),
    ("cc-by-nc", "Creative Commons Attribution NonCommercial"),
    ("cc-by-sa", "Creative Commons Attribution ShareAlike"),
    ("cc-by-sa", "cc by sa"),
    ("cc0", "CC0 1 0 Universal"),
    ("gpl-2", "GNU General Public License version 2"),
    ("gpl-3", "GNU General Public License version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl-3", "GNU Affero General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
]

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates() -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, whether its places are counted, words)."""
    both = [(label, True, text) for label, text in PHRASES] + [(label, False, text) for label, text in NOTICES]
    return [(i, label, base, re.findall("[0-9a-z]+", text.lower())) for i, (label, base, text) in enumerate(both)]


def _grams(spark: SparkSession) -> DataFrame:
    """h, gram, places: each gram of the templates once, with its (template, at); as many rows as the templates have words at most."""
    places: dict[tuple, list] = {}
    for i, _, _, words in templates():
        for at in range(len(words) - GRAM + 1):
            places.setdefault(tuple(words[at : at + GRAM]), []).append((i, at))
    rows = spark.createDataFrame([(list(g), p) for g, p in places.items()], "gram array<string>, places array<struct<template:int,at:int>>")
    return rows.select(F.xxhash64(*(F.get("gram", F.lit(j)) for j in range(GRAM))).alias("h"), "gram", "places")


def _hits(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_words, pos, places: a row for each gram of a document that templates have, and one without places for each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # lower() also maps characters beyond ASCII; none but the Kelvin sign becomes an ASCII letter, and no phrase has its k
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.split(F.lower(text), _BETWEEN).alias("w"))
    ahead = F.when(F.get("w", F.lit(0)) == "", 1).otherwise(0)
    behind = F.when((F.size("w") > ahead) & (F.element_at("w", -1) == ""), 1).otherwise(0)
    rows = rows.select("doc_id", "th", "w", ahead.alias("ahead"), (F.size("w") - ahead - behind).alias("n_words"))
    word = lambda i, j: F.get("w", i + F.col("ahead") + j)
    hashes = F.transform(F.sequence(F.lit(0), F.col("n_words") - GRAM), lambda i: F.xxhash64(*(word(i, j) for j in range(GRAM))))
    hashes = F.when(F.col("n_words") >= GRAM, hashes).otherwise(F.array().cast("array<bigint>"))
    grams = rows.select("doc_id", "th", "n_words", "w", "ahead", F.posexplode(F.concat(hashes, F.array(F.lit(None).cast("long")))).alias("pos", "h"))
    met = grams.join(F.broadcast(_grams(docs.sparkSession)), "h", "left")
    same = F.slice("w", F.col("pos") + F.col("ahead") + 1, F.lit(GRAM)) == F.col("gram")
    met = met.where(F.col("h").isNull() | (F.col("gram").isNotNull() & same))
    return met.select("doc_id", "th", F.col("n_words").cast("long").alias("n_words"), "pos", "places")


def _spans(hits: DataFrame) -> DataFrame:
    """hits -> doc_id, th, template, first and last (words of the span, the last one included), share: spans of grams of one template, each once for equal rows."""
    votes = hits.where(F.col("places").isNotNull()).select("doc_id", "th", "pos", F.inline("places"))
    # equal rows vote alike, so votes are sets; a diagonal has no more of them than its template has words
    diagonals = votes.groupBy("doc_id", "th", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("at"))
    sizes = F.lit([len(words) for _, _, _, words in templates()])
    slack = F.when(F.get(sizes, F.col("template")) >= LONG, F.floor(F.get(sizes, F.col("template")) / 8)).otherwise(0)
    own = W.partitionBy("doc_id", "th", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(own) > slack, F.lit(True)).cast("int")
    joined = diagonals.withColumn("new", new).withColumn("span", F.sum("new").over(own))
    words = F.transform("at", lambda a: F.sequence(a, a + GRAM - 1))
    found = joined.groupBy("doc_id", "th", "template", "span").agg(
        F.min(F.col("diagonal") + F.array_min("at")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("at") + GRAM - 1).alias("last"),
        F.size(F.array_distinct(F.flatten(F.flatten(F.collect_list(words))))).alias("stand"),
    )
    return found.select("doc_id", "th", "template", "first", "last", (F.col("stand") / F.get(sizes, F.col("template"))).alias("share"))


def _verified() -> Column:
    """Whether enough of the template's words stand in the span: all of a short one's."""
    size = F.get(F.lit([len(words) for _, _, _, words in templates()]), F.col("template"))
    part = (F.col("share") >= SHARE) & (F.col("last") - F.col("first") < 1.25 * size)
    return F.when(size >= LONG, part).otherwise(F.col("share") == 1)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, th (the text's hash), n_words, spans: (template, label, base, first, last, share) in order; a row for each document.

    spans holds all spans, also those that are not verified (`ok` false). A null text is empty; equal rows
    have equal results; no other column is read.
    """
    names, bases = [t[1] for t in templates()], [t[2] for t in templates()]
    with scratch() as kept:
        hits = written(_hits(docs), "hits")
        span = F.struct(
            "first", "last", F.get(F.lit(names), F.col("template")).alias("label"), F.get(F.lit(bases), F.col("template")).alias("base"), "template", "share", _verified().alias("ok"),
        )
        found = written(_spans(hits).groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(span)).alias("spans")), "spans")
        rows = hits.where(F.col("places").isNull()).select("doc_id", "th", "n_words").alias("d")
        on = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.th") == F.col("s.th"))
        none = F.array().cast(found.schema["spans"].dataType)
        out = rows.join(small(found).alias("s"), on, "left").select("d.doc_id", "d.th", "n_words", F.coalesce("spans", none).alias("spans"))
        kept.append(written(out, "licenses"))
    return kept[0]


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word (places of the counted phrases), base_labels, labels, score: the greatest share of a template in one span."""
    def labels(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    ok = F.filter("spans", lambda s: s["ok"])
    base = F.filter("spans", lambda s: s["ok"] & s["base"])
    starts = F.transform(base, lambda s: s["first"].cast("long"))
    return scan(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(ok).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


def labelled(docs: DataFrame) -> DataFrame:
    """docs with `licenses`, the labels found in each text in order (another name where docs has that column); all other columns stay."""
    i, th, name = fresh(docs, "license_doc", "license_text", "licenses")
    found = scan(docs).select(F.col("doc_id").alias(i), F.col("th").alias(th), F.filter("spans", lambda s: s["ok"]).alias(name)).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(th))
    names = F.array_sort(F.array_distinct(F.transform(name, lambda s: s["label"])))
    return docs.join(found, on, "left").select(*docs.columns, names.alias(name))
