"""Operator 10. License scans by diagonal voting. Native: DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, written

#: Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices as the licenses' publishers word them.
TEMPLATES = (
    ("agpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("cc-by-line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-line", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit-line", "Released under the MIT License."),
    ("mit-notice", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
#: Words in a rolling gram; the share of a template's grams that a label needs; how far diagonals of one passage may lie apart.
K, COVERAGE, DRIFT = 3, 0.6, 3
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def gram_hash(words: Column, at: Column, k: int) -> Column:
    """xxhash64 of the k words from `at` (from 0)."""
    return F.xxhash64(*[F.get(words, at + j) for j in range(k)])


def places(words: Column, n: Column, phrase: str) -> Column:
    """Where (from 0) the phrase's words stand in a row; only texts that hold its last word are searched."""
    wanted = phrase.split()
    first = F.filter(F.sequence(F.lit(0), n - len(wanted)), lambda i: _all([F.get(words, i + j) == w for j, w in enumerate(wanted)]))
    return F.when((n >= len(wanted)) & F.array_contains(words, wanted[-1]) & F.array_contains(words, wanted[0]), first).otherwise(F.expr("cast(array() as array<int>)"))


def _labelled(at: Column, label: str) -> Column:
    return F.transform(at, lambda i: F.struct(i.alias("place"), F.lit(label).alias("label")))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def template_grams(spark: SparkSession, templates: Sequence[tuple[str, str]], k: int) -> DataFrame:
    """One row per rolling gram: label, n_grams, hash, gram, template place. As many rows as the templates have words, about."""
    rows = spark.createDataFrame([(a, b) for a, b in templates], "label string, text string").withColumn("words", words_of(F.col("text"))).where(F.size("words") >= k)
    grams = rows.select("label", (F.size("words") - (k - 1)).alias("n_grams"), "words", F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("place"))
    return grams.select("label", "n_grams", gram_hash(F.col("words"), F.col("place"), k).alias("hash"), F.array_join(F.slice("words", F.col("place") + 1, k), " ").alias("gram"), "place")


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, k: int = K, coverage: float = COVERAGE, drift: int = DRIFT) -> DataFrame:
    """id, n_words, base (array of place and label), spans (array of label, start, end, coverage), score.

    Every text's rolling word grams are hashed and kept where a template has the hash (the templates' hashes are a constant of some
    hundred numbers), then joined to the template's places. Each match votes for its diagonal, document place minus template place;
    diagonals that lie within `drift` of the one before are one passage, so a word more or less doesn't split it. A passage whose
    distinct template grams, verified word by word, are at least `coverage` of the template's is a span. The votes of a document
    are summed where they arise and meet in a group of their own, so no key is frequent; grams that no template has never move.

    Null text has no words; repeated rows and ids each get their row; an empty table gives none; further columns are ignored; texts
    of any length are scanned whole. score is the best coverage of any span, 1 where a phrase stands, else that of no span: 0."""
    spark = docs.sparkSession
    table = written(template_grams(spark, templates, k).coalesce(1), "license-templates")
    hashes = sorted({r["hash"] for r in table.select("hash").collect()})  # bounded by the templates
    words, n = F.col("words"), F.col("n")
    rows = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words")).withColumn("n", F.size("words"))
    found = [_labelled(places(words, n, p), label) for p, label in phrases]
    hits = F.filter(F.transform(F.sequence(F.lit(0), n - k), lambda i: F.struct(i.alias("at"), gram_hash(words, i, k).alias("hash"))), lambda x: x["hash"].isin(hashes))
    hits = F.when(n >= k, F.transform(hits, lambda x: F.struct(x["at"].alias("at"), x["hash"].alias("hash"), F.array_join(F.slice(words, x["at"] + 1, k), " ").alias("gram")))).otherwise(F.expr("cast(array() as array<struct<at:int,hash:bigint,gram:string>>)"))
    rows = written(rows.select("id", n.cast("long").alias("n_words"), F.array_sort(F.concat(*found)).alias("base"), hits.alias("hits")).withColumn("row", F.monotonically_increasing_id()), "license-grams")

    votes = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    votes = votes.join(F.broadcast(table.withColumnRenamed("gram", "own")), "hash").where(F.col("gram") == F.col("own"))  # as large as the templates
    votes = votes.withColumn("diagonal", F.col("at") - F.col("place"))
    lines = votes.groupBy("row", "label", "n_grams", "diagonal").agg(F.collect_set("place").alias("seen"), F.min("at").alias("start"), (F.max("at") + k).alias("end"))
    by = Window.partitionBy("row", "label").orderBy("diagonal")
    lines = lines.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(by) > drift).cast("int")).withColumn("passage", F.sum(F.coalesce("new", F.lit(0))).over(by))
    spans = lines.groupBy("row", "label", "n_grams", "passage").agg(F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.withColumn("coverage", F.col("n") / F.col("n_grams")).where(F.col("coverage") >= coverage)
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", "start", "end", "coverage"))).alias("spans"))

    with_hits = rows.where(F.size("hits") > 0).drop("hits").join(spans, "row", "left")
    others = rows.where(F.size("hits") == 0).drop("hits").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    out = with_hits.unionByName(others).withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), "n_words", "base", "spans", score.alias("score"))


def report(found: DataFrame) -> DataFrame:
    """n_base, first_word, last_word, base_labels and labels from license_scan()'s columns."""
    at, own = F.transform("base", lambda b: b["place"]), F.transform("base", lambda b: b["label"])
    join = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return (
        found.withColumn("n_base", F.size("base").cast("long"))
        .withColumn("first_word", F.array_min(at).cast("long"))
        .withColumn("last_word", F.array_max(at).cast("long"))
        .withColumn("base_labels", join(own))
        .withColumn("labels", join(F.concat(own, F.transform("spans", lambda s: s["label"]))))
    )
