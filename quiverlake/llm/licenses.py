"""License scans by diagonal voting. DataFrame functions only.

Every run of k words in a text is hashed and joined to the places where the templates have that hash.
A hit's diagonal is its place in the text less its place in the template, so a copied passage puts all
its hits on one diagonal, and each word put in or left out moves the rest to a neighbouring one. Hits
are counted by diagonal, neighbouring diagonals merge to a span, and a span counts if the words of its
hits, compared as words and not as hashes, cover enough of the template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM_SEPARATORS, ascii_lower, let, read_table

#: Fixed phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Fixed texts: notices of well-known licenses, sentence by sentence, with a label for each.
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the BSD 3-Clause License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """(hash, gram, template, label, place, words): a row for each run of k words of each template."""
    table = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    words = F.array_remove(F.split(ascii_lower(F.col("text")), ALNUM_SEPARATORS), "")
    table = table.withColumn("w", words).where(F.size("w") >= k).withColumn("place", F.explode(F.sequence(F.lit(0), F.size("w") - k)))
    gram = [F.get("w", F.col("place") + j) for j in range(k)]
    return table.select(F.xxhash64(*gram).alias("hash"), F.concat_ws(" ", *gram).alias("gram"), "template", "label", "place", F.size("w").alias("words"))


def phrase_places(words: Column, phrase: str) -> Column:
    """Where a phrase's words stand one after the other."""
    parts = phrase.split(" ")
    places = F.filter(
        F.sequence(F.lit(0), F.size(words) - len(parts)),
        lambda i: F.get(words, i).eqNullSafe(parts[0]) & (F.concat_ws(" ", *(F.get(words, i + j) for j in range(len(parts)))) == phrase),
    )
    return F.when(F.array_contains(words, parts[-1]) & (F.size(words) >= len(parts)), places).otherwise(F.array().cast("array<int>"))


def labelled_places(words: Column, phrase: str, label: str) -> Column:
    return F.transform(phrase_places(words, phrase), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] | None = None,
    k: int = 4,
    slack: int = 3,
    least: float = 0.6,
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels (both
    arrays), score, spans.

    Base: places of PHRASES. spans holds (label, template, start, end, coverage), in words, of verified
    spans: the distinct template words in its hits are `least` of the template or more. Diagonals merge
    if they differ by up to `slack` from the next. score is the best coverage, and at least 0.5 where a
    phrase stands.

    Null text has no words. Null and repeated doc_ids keep their rows, each judged by itself. Long texts
    are scanned whole. An empty table gives no rows; other columns are not looked at. A template of fewer
    than k words has no run to find, which is a ValueError. Templates are broadcast if their runs take
    at most `broadcast_bytes`, and joined by a shuffle of the hashes beyond.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    grams = template_grams(spark, templates, k)
    measured = grams.agg(F.countDistinct("template"), F.sum(F.octet_length("gram") + 64)).first()
    if measured[0] != len(templates):
        raise ValueError(f"a template has fewer than {k} words")
    if templates and measured[1] <= broadcast_bytes:
        grams = F.broadcast(grams)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.array_remove(F.split(ascii_lower(text), ALNUM_SEPARATORS), "").alias("w"),
    )

    def hashes(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))

    base = F.array_sort(F.flatten(F.array(*(labelled_places(F.col("w"), phrase, label) for phrase, label in PHRASES))))
    # the first place, without a hash, stands for the text itself
    every = F.concat(F.array(F.lit(None).cast("long")), F.when(F.size("w") >= k, let(F.col("w"), hashes)).otherwise(F.array().cast("array<long>")))
    rows = rows.select("row", "doc_id", "w", F.size("w").cast("long").alias("n_words"), base.alias("base"), every.alias("hashes"))
    heads = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    rows = rows.select(
        "row",
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.get("base", F.lit(0))["at"].cast("long").alias("first_word"),
        F.when(F.size("base") > 0, F.element_at("base", -1)["at"]).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"]))).alias("base_labels"),
        "w",
        "hashes",
    ).select("row", F.struct(*heads).alias("head"), "w", "hashes")
    each = rows.select("row", "head", "w", F.posexplode("hashes").alias("n", "hash"))
    each = each.select("row", "head", "hash", (F.col("n") - 1).alias("at"), F.concat_ws(" ", *(F.get("w", F.col("n") - 1 + j) for j in range(k))).alias("words_here"))
    # words are put together only where a hash is met: the join and the filter are in one generated loop
    voted = each.join(grams, "hash", "left").where((F.col("at") < 0) | (F.col("words_here") == F.col("gram")))
    voted = voted.select("row", "head", "template", "label", "words", "at", "place", (F.col("at") - F.col("place")).alias("diagonal"))
    diagonals = voted.groupBy("row", "head", "template", "label", "words", "diagonal").agg(
        F.min("at").alias("start"), F.max("at").alias("end"), F.collect_set("place").alias("places")
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > slack
    merged = diagonals.withColumn("apart", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("span", F.sum("apart").over(order))
    spans = merged.groupBy("row", "head", "template", "label", "words", "span").agg(
        F.min("start").alias("start"), (F.max("end") + k).alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places")
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    matched = F.aggregate(
        "places", zero, lambda a, p: F.struct((a["n"] + p + k - F.greatest(p, a["to"])).alias("n"), (p + k).alias("to")), lambda a: a["n"]
    )
    coverage = matched / F.col("words")
    verified = F.when(coverage >= least, F.struct("label", "template", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), coverage.alias("coverage")))
    found = spans.groupBy("row", "head").agg(F.array_sort(F.collect_list(verified)).alias("spans"))
    best = F.coalesce(F.array_max(F.transform("spans", lambda x: x["coverage"])), F.lit(0.0))
    return found.select(
        "head.*",
        F.array_sort(F.array_distinct(F.concat("head.base_labels", F.transform("spans", lambda x: x["label"])))).alias("labels"),
        F.greatest(best, F.when(F.col("head.n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
        "spans",
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score"
    )
