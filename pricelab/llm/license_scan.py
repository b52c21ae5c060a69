"""License scans by diagonal voting.

* Base: the places where the words of a phrase of ``PHRASES`` stand consecutively.
* Method: every rolling run of ``RUN`` words of every text is hashed and joined with the runs of the license
  templates. A match at word i of the text and word j of a template votes for the diagonal i - j. Votes are
  counted by (text, template, diagonal); diagonals at most ``GAP`` apart are merged, so that a few added or
  missing words don't split a license. A merged group is verified on the words themselves: each vote's
  words must be the template's, at least ``COVERED`` of the template's runs must be found, each counted once,
  and the span must not be longer than the template by more than half of its length and ``GAP`` words.

The templates are a fixed table of a few thousand runs, which bounds the broadcast. A text's words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, lower-cased.

Rows: a null text is empty: no words, no labels, null positions, score 0. Repeated rows are scanned as separate
rows. Extra columns are ignored; an empty table gives an empty result. DataFrame operations only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelab.session import small_frame

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RUN = 3
GAP = 3
COVERED = 0.7

#: Phrase -> label of the base search.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Fixed values: (label, text) of the templates: the public notices of common licenses.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the Software), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
               "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR "
               "CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
            "(at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
)


def words(text: Column) -> Column:
    # full lower-casing: besides A-Z it changes non-ASCII letters alone, which are in no phrase, and no word border
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def _template_runs(spark: SparkSession, templates) -> DataFrame:
    """(hash, w0 .. , template, label, at, runs, length) of every run of every template."""
    rows = []
    for number, (label, text) in enumerate(templates):
        own = [w for w in re.split(SEPARATOR, text.lower()) if w]
        if len(own) < RUN:
            raise ValueError(f"a template needs {RUN} words")
        for at in range(len(own) - RUN + 1):
            rows.append((*own[at: at + RUN], number, label, at, len(own) - RUN + 1, len(own)))
    names = [f"t{k}" for k in range(RUN)]
    frame = small_frame(spark, rows, ", ".join(f"{n} string" for n in names) + ", template int, label string, at int, runs int, length int")
    return frame.withColumn("hash", F.xxhash64(*names))


def votes(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(rid, template, label, runs, length, diagonal, at, place) of every matching run of words."""
    placed = docs.select("rid", words(F.col("text")).alias("words")).filter(F.size("words") >= RUN)
    placed = placed.select("rid", "words", F.posexplode("words").alias("place", "w0")).filter(F.col("place") <= F.size("words") - RUN)
    for k in range(1, RUN):
        placed = placed.withColumn(f"w{k}", F.get("words", F.col("place") + k))
    placed = placed.withColumn("hash", F.xxhash64(*[f"w{k}" for k in range(RUN)])).drop("words")
    matched = placed.join(F.broadcast(_template_runs(docs.sparkSession, templates)), "hash")
    same = F.lit(True)
    for k in range(RUN):
        same = same & (F.col(f"w{k}") == F.col(f"t{k}"))
    return matched.filter(same).select("rid", "template", "label", "runs", "length", (F.col("place") - F.col("at")).alias("diagonal"), "at", "place")


def spans(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(rid, template, label, first, last, covered, verified): merged diagonals; words first .. last of the text."""
    by = ["rid", "template", "label", "runs", "length"]
    diagonals = votes(docs, templates).groupBy(*by, "diagonal").agg(
        F.collect_set("at").alias("ats"), F.min("place").alias("first"), (F.max("place") + RUN - 1).alias("last"))
    w = Window.partitionBy("rid", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > GAP).cast("int"), F.lit(0))
    merged = (diagonals.withColumn("apart", apart).withColumn("group", F.sum("apart").over(w))
              .groupBy(*by, "group").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("found"),
                                         F.min("first").alias("first"), F.max("last").alias("last")))
    covered = F.col("found") / F.col("runs")
    short = F.col("last") - F.col("first") + 1 <= F.col("length") * 1.5 + GAP
    return merged.select("rid", "template", "label", "first", "last", covered.alias("covered"),
                         ((covered >= COVERED) & short).alias("verified"))


def _base(own: Column) -> Column:
    """Sorted array of (start, label) of the phrases' places."""
    places = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()

        def start(w: Column, i: Column) -> Column:
            hit = w == parts[0]  # noqa: B023 - used before the next phrase
            for k, part in enumerate(parts[1:], 1):  # noqa: B023
                hit = hit & (F.get(own, i + k) == part)
            return F.when(hit, F.struct(i.alias("start"), F.lit(label).alias("label")))  # noqa: B023

        found = F.filter(F.transform(own, start), lambda x: x.isNotNull())
        places.append(F.when(F.array_contains(own, parts[0]) & F.array_contains(own, parts[-1]), found))
    empty = F.array().cast("array<struct<start:int,label:string>>")
    return F.array_sort(F.concat(*[F.coalesce(p, empty) for p in places]))


def scan(documents: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, n_spans and score of every row.

    ``score``: 1 where a base phrase stands, else the largest share of a template's runs in one group."""
    docs = documents.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                            F.col("text").cast("string").alias("text"))
    base = (docs.withColumn("words", words(F.col("text")))
            .select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), _base(F.col("words")).alias("base")))
    found = spans(docs, templates).groupBy("rid").agg(
        F.collect_set(F.when(F.col("verified"), F.col("label"))).alias("own"), F.max("covered").alias("covered"),
        F.count(F.when(F.col("verified"), 1)).alias("n_spans"))
    rows = base.join(found, "rid", "left")
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    own = F.coalesce("own", F.array().cast("array<string>"))
    starts = F.transform("base", lambda x: x["start"])
    n_base = F.size("base")
    return rows.select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, own)), ",").alias("labels"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("covered", F.lit(0.0))).alias("score"))
