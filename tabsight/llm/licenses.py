"""License scans by diagonal voting (operator 10), DataFrame functions only.

Every rolling word k-gram of every text is hashed and joined to the positions
of the same gram in the license templates (a fixed table of a few hundred
rows, so it is broadcast).  A hit votes for its diagonal, document position
minus template position: words copied from a template in order share one
diagonal, an inserted or dropped word moves the rest to a neighbouring one.
Votes are aggregated per diagonal, diagonals at most ``GAP`` apart are merged,
and a merged span is verified: the words behind each vote are compared with
the template's (not only their hashes), and the span must cover enough of the
template without being much longer than what it covers.

k is 3, or the template's length where that is less; grams are joined by the
hash of their first two words, the third is part of the join's condition.

The three base phrases are templates of two and three words: each of their
hits is a place of the phrase.

Defined cases: null and empty texts have no words, no labels and score 0;
texts are scanned whole; repeated rows and repeated ids give one result row
each (rows are told apart by their position in the scan); an empty table
gives an empty result.
"""
from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm.common import written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
GAP = 3            # diagonals this far apart are merged
COVERAGE = 0.7     # part of the template a span must cover ...
WHOLE = 12         # ... but templates up to this many words must be covered whole: one word tells them apart
DENSITY = 0.6      # covered words / words of the span

# The phrases of the contract and public license notices.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl": [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation",
        "licensed under the GNU General Public License",
    ],
    "lgpl": ["under the terms of the GNU Lesser General Public License"],
    "agpl": ["under the terms of the GNU Affero General Public License"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
        "BSD 3-Clause License", "BSD 2-Clause License",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "cc-by": ["licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "cc-by-sa": ["licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
                 "Licensed under CC BY-SA 4.0"],
    "cc-by-nc": ["licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
                 "Licensed under CC BY-NC 4.0"],
}


def template_words(text: str) -> list[str]:
    lowered = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return [w for w in re.split(SEPARATORS, lowered) if w]


def template_grams(spark, templates=None, phrases=None) -> DataFrame:
    """One row per template position: (tmpl, label, base, length, k, tpos, a, b, c)."""
    rows, listed = [], [(t, label, False) for label, ts in (templates or TEMPLATES).items() for t in ts]
    listed += [(p, label, True) for p, label in (phrases or BASE_PHRASES).items()]
    for number, (text, label, base) in enumerate(listed):
        w = template_words(text)
        k = min(K, len(w))
        if k < 2:
            raise ValueError("a template needs at least two words")
        rows += [(number, label, base, len(w), k, i, w[i], w[i + 1], w[i + 2] if k == 3 else None)
                 for i in range(len(w) - k + 1)]
    df = spark.createDataFrame(rows, "tmpl int, label string, base boolean, length int, k int, tpos int, "
                                     "a string, b string, c string")
    return df.withColumn("gram", F.xxhash64("a", "b"))


def hits(docs: DataFrame, grams: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified gram hits, and one row per document that carries its id and
    word count (``tmpl`` null unless that place is also a hit)."""
    lowered = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), string.ascii_uppercase,
                          string.ascii_lowercase)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"),
                       F.array_remove(F.split(lowered, SEPARATORS), "").alias("w"))
    rest = F.lit(2 ** 31 - 1)
    rows = rows.select("uid", "doc_id", F.size("w").cast("long").alias("n_words"),
                       F.arrays_zip(F.col("w").alias("x"), F.slice("w", F.lit(2), rest).alias("y"),
                                    F.slice("w", F.lit(3), rest).alias("z")).alias("g"))
    rows = rows.select("uid", "doc_id", "n_words", F.posexplode_outer("g").alias("pos", "g"))
    rows = rows.select("uid", "doc_id", "n_words", "pos", "g.x", "g.y", "g.z")
    on = ((F.xxhash64("x", "y") == F.col("gram")) & (F.col("x") == F.col("a")) & (F.col("y") == F.col("b"))
          & (F.col("c").isNull() | (F.col("z") == F.col("c"))))
    return (rows.join(F.broadcast(grams), on, "left")       # the template table: fixed, a few hundred rows
            .filter(F.col("tmpl").isNotNull() | F.col("pos").isNull() | (F.col("pos") == 0))
            .select("uid", "doc_id", "n_words", F.col("pos").cast("long").alias("pos"), "tmpl", "label", "base",
                    "length", "k", "tpos"))


def spans(found: DataFrame) -> DataFrame:
    """Verified spans per document and template: (uid, label, start, end, coverage)."""
    votes = (found.filter("tmpl is not null and not base")
             .groupBy("uid", "tmpl", "label", "length", "k", (F.col("pos") - F.col("tpos")).alias("diagonal"))
             .agg(F.collect_set("tpos").alias("at"), F.min("pos").alias("first"), F.max("pos").alias("last")))
    order = Window.partitionBy("uid", "tmpl").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > GAP, F.lit(True)).cast("int")
    merged = (votes.withColumn("new", new).withColumn("run", F.sum("new").over(order))
              .groupBy("uid", "tmpl", "label", "length", "k", "run")
              .agg(F.flatten(F.collect_list("at")).alias("at"), F.min("first").alias("start"),
                   (F.max("last") + F.max("k")).alias("end")))
    k = F.col("k")
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t, t + k - 1)))))
    return (merged.withColumn("covered", covered)
            .withColumn("coverage", F.col("covered") / F.col("length"))
            .withColumn("verified", (F.col("coverage") >= F.when(F.col("length") <= WHOLE, 1.0).otherwise(COVERAGE))
                        & (F.col("covered") >= DENSITY * (F.col("end") - F.col("start")))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels,
    labels, score (1 for a base phrase, else the best span's coverage)."""
    # the texts are read once: the few hits are written, then one exchange by document serves all below
    found = written(hits(docs, template_grams(docs.sparkSession, templates), id_col, text_col), "license_hits")
    found = found.repartition("uid")
    base = F.col("base") & F.col("tmpl").isNotNull()
    direct = found.groupBy("uid").agg(
        F.max("n_words").alias("n_words"), F.first("doc_id", ignorenulls=True).alias("doc_id"),
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("pos"))).alias("first_word"),
        F.max(F.when(base, F.col("pos"))).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_set"))
    by_span = spans(found).groupBy("uid").agg(
        F.collect_set(F.when(F.col("verified"), F.col("label"))).alias("own_set"),
        F.max(F.when(F.col("verified"), F.col("coverage")).otherwise(F.col("coverage") * 0.5)).alias("best"))
    none = F.array().cast("array<string>")
    own = F.coalesce("own_set", none)
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.least(F.coalesce("best", F.lit(0.0)), F.lit(1.0)))
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return (direct.join(by_span, "uid", "left")
            .select("doc_id", "n_words", "n_base", "first_word", "last_word", join(F.col("base_set")).alias("base_labels"),
                    join(F.concat("base_set", own)).alias("labels"), score.alias("score")))
