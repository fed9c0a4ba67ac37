r"""License scans by diagonal voting, in DataFrame expressions only.

A text's words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of its lower-cased (A-Z) form. Every run of `k`
words is hashed and joined with the runs of the templates, a table of a fixed few rows that is
broadcast; a hash that hits counts if the words are the same. A hit votes for the diagonal (place in
the text less place in the template). Diagonals of a template in one text that lie within `drift` of
each other are one candidate, so words put in or left out don't cut a notice in two. A candidate is
verified on its span: the template's runs that it holds, each once, over the larger of the
template's runs and the span's own runs. At `least` or more its label is found there, and that share
is the span's score. What a candidate has covered is kept as bits by place in the template, so no
list of hits is gathered, however long the text or frequent a run.

Besides, base phrases count where their words stand next to each other (`BASE`). A text's score is the best
verified span's, at least 0.5 if it has a base phrase, 0 without either.

Null and empty texts have no word and no label. Rows count one by one, whatever their ids: rows are
told apart by id and two 64-bit hashes of the text, and copies have the same labels anyway. Equal
spans are all reported, in order. Texts without a word of a template cost one look for each word.
An empty table gives no rows; other columns are left alone, and names that clash don't matter, as
only the id and the text are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import stored

APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrase -> label
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Wordings of public license notices, label -> texts of at most 256 words
NOTICES = {
    "mit-notice": ["Released under the MIT License", "Licensed under the MIT License", "Distributed under the MIT License", "This project is licensed under the terms of the MIT license"],
    "mit-text": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights "
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3", "licensed under the GNU General Public License version 3 or later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "gpl-2.0": [
        "licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ],
    "lgpl": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "cc-by-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"],
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """`body` of the value, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(low: Column) -> Column:
    return F.array_remove(F.split(low, APART), "")


def base_places(low: Column, words: Column, base: dict[str, str]) -> Column:
    """array<struct<at, label>>: where base phrases start; only texts that hold a phrase's last word are looked through."""
    label = lambda ws, i: F.coalesce(*[F.when(_stands(ws, i, p.split()), F.lit(name)) for p, name in base.items()])
    maybe = F.lit(False)
    for last in sorted({p.split()[-1] for p in base}):
        maybe = maybe | F.contains(low, F.lit(last))
    found = let(words, lambda ws: F.filter(F.transform(F.sequence(F.lit(0), F.size(ws)), lambda i: F.struct(i.alias("at"), label(ws, i).alias("label"))), lambda x: x.label.isNotNull()))
    return F.when(maybe, found).otherwise(F.expr("cast(array() AS array<struct<at: int, label: string>>)"))


def _stands(ws: Column, i: Column, phrase: list[str]) -> Column:
    out = F.lit(True)
    for j, w in enumerate(phrase):
        out = out & (F.get(ws, i + j) == w)
    return out


def templates(spark: SparkSession, notices: dict[str, list[str]], k: int) -> DataFrame:
    """template, label, runs (how many), place, run (words), hash: a row for each run of `k` words."""
    rows = []
    for label, texts in notices.items():
        for text in texts:
            words = [w for w in re.split(APART, text.lower()) if w]
            if not k <= len(words) <= 256:
                raise ValueError(f"a notice of {label} has {len(words)} words")
            template, runs = len({r[0] for r in rows}), len(words) - k + 1
            rows += [(template, label, runs, i, words[i : i + k]) for i in range(runs)]
    made = spark.createDataFrame(rows, "template int, label string, runs int, place int, run array<string>")
    return made.withColumn("hash", F.xxhash64(*[F.get("run", F.lit(j)) for j in range(k)]))


def row_key(key: str, text: Column) -> list[Column]:
    """What tells rows apart: the id and 128 bits of the text."""
    return [F.col(key).alias("_id"), F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2")]


KEY = ["_id", "_h1", "_h2"]


def hits(docs: DataFrame, key: str, text: str, known: DataFrame, k: int) -> DataFrame:
    """A row for each run of the texts that is one of a template: at (in the text), template, label, runs, place."""
    words = docs.select(*row_key(key, F.col(text)), words_of(lowered(F.col(text))).alias("_words")).where(F.size("_words") >= k)
    each = words.select(*KEY, "_words", F.posexplode("_words").alias("at", "_word")).where(F.col("at") <= F.size("_words") - k)
    at = [F.get("_words", F.col("at") + j) for j in range(k)]
    hashed = each.select(*KEY, "_words", "at", F.xxhash64(*at).alias("hash"))
    same = F.lit(True)
    for j in range(k):
        same = same & (F.get("_words", F.col("at") + j) == F.get("run", F.lit(j)))
    return hashed.join(F.broadcast(known), "hash").where(same).select(*KEY, "at", "template", "label", "runs", "place")


def spans(found: DataFrame, k: int, drift: int, least: float) -> DataFrame:
    """Verified spans: KEY, label, first and last word, score."""
    bits = [F.bit_or(F.when(F.floor(F.col("place") / 64) == b, F.expr("shiftleft(1L, place % 64)")).otherwise(F.lit(0))).alias(f"b{b}") for b in range(4)]
    own = [*KEY, "template", "label", "runs"]
    lines = found.groupBy(*own, (F.col("at") - F.col("place")).alias("line")).agg(F.min("at").alias("lo"), F.max("at").alias("hi"), *bits)
    order = Window.partitionBy(*KEY, "template").orderBy("line")
    apart = F.coalesce((F.col("line") - F.lag("line").over(order) > drift).cast("int"), F.lit(0))
    grouped = lines.withColumn("apart", apart).withColumn("group", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.groupBy(*own, "group").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.bit_or(f"b{b}").alias(f"b{b}") for b in range(4)])
    covered = sum((F.bit_count(f"b{b}") for b in range(4)), F.lit(0))
    score = F.round(covered / F.greatest("runs", F.col("hi") - F.col("lo") + 1), 6)
    return merged.select(*KEY, "label", F.col("lo").alias("first"), (F.col("hi") + (k - 1)).alias("last"), score.alias("score")).where(F.col("score") >= least)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", base: dict[str, str] = BASE, notices: dict[str, list[str]] = NOTICES, k: int = 3, drift: int = 3, least: float = 0.6) -> DataFrame:
    """Every row's key, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans (array of label, first, last, score)."""
    low = lowered(F.col(text))
    plain = docs.select(*row_key(key, F.col(text)), low.alias("_low")).select(*KEY, "_low", words_of(F.col("_low")).alias("_words"))
    plain = plain.select(*KEY, F.size("_words").cast("long").alias("n_words"), base_places(F.col("_low"), F.col("_words"), base).alias("_base"))
    found = spans(hits(docs, key, text, templates(docs.sparkSession, notices, k), k), k, drift, least)
    by = stored(found.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("first", "last", "label", "score"))).alias("spans")), "spans")
    keys = [F.col(f"p.{x}").eqNullSafe(F.col(f"f.{x}")) for x in KEY]
    both = plain.alias("p").join(by.alias("f"), keys[0] & keys[1] & keys[2], "left").select("p.*", F.coalesce("f.spans", F.expr("cast(array() AS array<struct<first: int, last: int, label: string, score: double>>)")).alias("spans"))
    at, names = F.transform("_base", lambda x: x.at), F.transform("_base", lambda x: x.label)
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.greatest(F.coalesce(F.array_max(F.transform("spans", lambda s: s.score)), F.lit(0.0)), F.when(F.size("_base") > 0, 0.5).otherwise(0.0))
    return both.select(
        F.col("_id").alias(key), "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        joined(names).alias("base_labels"), joined(F.concat(names, F.transform("spans", lambda s: s.label))).alias("labels"), score.alias("score"), "spans",
    )
