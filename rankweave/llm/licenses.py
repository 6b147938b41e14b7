"""License texts in documents, by votes for diagonals.

Every rolling word k-gram of every document is met with the k-grams of the license
templates through an equi-join on their hashes. A hit at word p of a document and word
t of a template votes for the diagonal p - t: an intact copy puts all its votes on one
diagonal, a copy with words put in or left out on several neighbouring ones. Votes are
counted for each diagonal, neighbouring diagonals are merged to spans, and a span is
verified by the share of the template's words that its hits cover.

Templates of two or three words (phrases) are matched with 2-grams and have to be whole,
so every place of a phrase is a diagonal with all its votes. Longer templates use
4-grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.session import at_most

# Phrases with their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
# Opening or telling passages of well-known licenses, with their labels.
TEMPLATES = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software",
        "mit",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in "
        "compliance with the license you may obtain a copy of the license at",
        "apache",
    ),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "apache",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation either version",
        "gpl",
    ),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided "
        "that the following conditions are met",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is "
        "hereby granted",
        "isc",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl "
        "was not distributed with this file you can obtain one at",
        "mpl",
    ),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "reserved"),
)

PHRASE_WORDS = 3
SHORT, LONG = 2, 4
# Diagonals this close (or a quarter of a short template) belong to one copy.
SLACK = 6
# Share of a long template's words that must be covered.
COVER = 0.6
# Template k-grams up to this number are broadcast (about 60 bytes each).
BROADCAST_GRAMS = 1_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text: digits, lower-cased A-Z, and all beyond ASCII."""
    lowered = F.translate(
        F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def _grams(words: Column, k: int) -> list[Column]:
    return [F.slice(words, i + 1, F.greatest(F.size(words) - i, F.lit(0))).alias(f"w{i}") for i in range(k)]


def template_grams(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(k, gram hash, hits): where each k-gram stands in the templates, one row per k-gram.

    ``hits`` is an array of (template, label, words of the template, k, position).
    """
    rows = []
    for number, (text, label) in enumerate(templates):
        words = text.split()
        k = SHORT if len(words) <= PHRASE_WORDS else LONG
        if len(words) < k:
            raise ValueError(f"a template needs {SHORT} words or more: {text!r}")
        rows += [
            (k, words[t : t + k] + [None] * (LONG - k), number, label, len(words), t) for t in range(len(words) - k + 1)
        ]
    grams = spark.createDataFrame(rows, "k int, words array<string>, template int, label string, length int, t int")
    return (
        grams.withColumn("gram", F.xxhash64(*[F.col("words")[i] for i in range(LONG)]))
        .groupBy("k", "gram", "words")
        .agg(F.collect_list(F.struct("template", "label", "length", "k", "t")).alias("hits"))
    )


def find_licenses(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    phrases: tuple = PHRASES,
    templates: tuple = TEMPLATES,
) -> DataFrame:
    """One row per row of ``docs``: key, n_words and ``spans``.

    ``spans`` is an array of (first, last, label, template, phrase, cover), words
    counted from 0 and ``last`` exclusive, sorted by place; ``cover`` is the covered
    share of the template, 1 for phrases. Null texts have no words. Repeated rows give
    repeated results, null keys are kept, other columns not carried.

    A document's hits meet by key and a hash of its text; the join with the templates
    moves nothing, and only hits and one row per document are shuffled.
    """
    spark = docs.sparkSession
    short, long = _joined_sides(spark, [*phrases, *templates])
    words = docs.select(
        F.col(key).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), words_of(F.col(text)).alias("words")
    )
    # One more row for each document, at position -1, carries its number of words.
    rows = words.select(
        "id",
        "text_hash",
        F.size("words").alias("n_words"),
        F.posexplode(F.arrays_zip(*_grams(F.concat(F.array(F.lit("")), F.col("words")), LONG))).alias("p1", "g"),
    ).select("id", "text_hash", "n_words", (F.col("p1") - 1).alias("p"), *[F.col(f"g.w{i}").alias(f"w{i}") for i in range(LONG)])
    rows = rows.withColumn("gram2", F.xxhash64("w0", "w1", F.lit(None).cast("string"), F.lit(None).cast("string")))
    rows = rows.withColumn("gram4", F.xxhash64("w0", "w1", "w2", "w3"))
    met = rows.join(short, "gram2", "left").join(long, "gram4", "left")
    same2 = (F.col("w0") == F.col("words2")[0]) & (F.col("w1") == F.col("words2")[1])
    same4 = F.lit(True)
    for i in range(LONG):
        same4 = same4 & (F.col(f"w{i}") == F.col("words4")[i])
    none = F.array().cast("array<struct<template:int,label:string,length:int,k:int,t:int>>")
    inside = F.col("p") >= 0
    hits = F.concat(
        F.when(same2 & inside, F.col("hits2")).otherwise(none), F.when(same4 & inside, F.col("hits4")).otherwise(none)
    )
    kept = met.where(F.col("hits2").isNotNull() | F.col("hits4").isNotNull() | (F.col("p") < 0))
    votes = kept.select("id", "text_hash", "n_words", "p", F.explode_outer(hits).alias("h")).where(
        F.col("h").isNotNull() | (F.col("p") < 0)
    )
    copies = F.sum(F.when(F.col("p") < 0, 1).otherwise(0)).alias("copies")
    # Repeated rows vote for the same positions, so sets keep the count right.
    diagonals = votes.groupBy(
        "id", "text_hash", F.col("h.template").alias("template"), (F.col("p") - F.col("h.t")).alias("diagonal")
    ).agg(
        F.max("n_words").alias("n_words"),
        copies,
        F.first("h.label").alias("label"),
        F.first("h.length").alias("length"),
        F.first("h.k").alias("k"),
        F.collect_set("h.t").alias("at"),
    )
    spans = _merged(diagonals, len(phrases))
    return (
        spans.groupBy("id", "text_hash")
        .agg(
            F.max("n_words").alias("n_words"),
            F.max("copies").alias("copies"),
            F.sort_array(
                F.filter(F.collect_list("span"), lambda s: s.isNotNull())
            ).alias("spans"),
        )
        .select(F.col("id").alias(key), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), F.col("n_words").cast("long"), "spans")
        .drop("copy")
    )


def _joined_sides(spark: SparkSession, templates: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    grams = template_grams(spark, templates)
    sides = []
    for k in (SHORT, LONG):
        side = grams.where(F.col("k") == k).select(
            F.col("gram").alias(f"gram{k}"), F.col("words").alias(f"words{k}"), F.col("hits").alias(f"hits{k}")
        )
        sides.append(F.broadcast(side) if at_most(side, BROADCAST_GRAMS) else side)
    return sides[0], sides[1]


def _merged(diagonals: DataFrame, phrases: int) -> DataFrame:
    """Neighbouring diagonals joined to spans, those that stand verification kept.

    The rows without a template (one per document) stay, without a span.
    """
    low = F.col("diagonal") + F.array_min("at")
    high = F.col("diagonal") + F.array_max("at") + F.col("k")
    is_phrase = F.col("template") < phrases
    order = Window.partitionBy("id", "text_hash", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    placed = (
        diagonals.withColumn("low", low)
        .withColumn("high", high)
        .withColumn("new", F.when(F.col("template").isNull() | is_phrase | gap.isNull() | (gap > F.least(F.lit(SLACK), F.floor(F.col("length") / 4))), 1).otherwise(0))
    )
    placed = placed.withColumn("group", F.sum("new").over(order))
    covered = F.array_distinct(
        F.flatten(F.collect_list(F.flatten(F.transform("at", lambda t: F.sequence(t, t + F.col("k") - 1)))))
    )
    joined = placed.groupBy("id", "text_hash", "template", "group").agg(
        F.max("n_words").alias("n_words"),
        F.max("copies").alias("copies"),
        F.first("label").alias("label"),
        F.first("length").alias("length"),
        F.min("low").alias("first"),
        F.max("high").alias("last"),
        covered.alias("covered"),
    )
    cover = F.size("covered") / F.col("length")
    stands = F.when(is_phrase | (F.col("length") <= PHRASE_WORDS), cover >= 1).otherwise(cover >= COVER)
    span = F.struct(
        F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "label", "template", is_phrase.alias("phrase"), cover.alias("cover")
    )
    return joined.select("id", "text_hash", "n_words", "copies", F.when(stands, span).alias("span"))
