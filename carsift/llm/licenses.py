"""License scan by diagonal voting, in DataFrame operations only.

Every rolling word k-gram of every document is joined with the places where it stands in the license templates. A hit votes
for its diagonal (place in the document minus place in the template). Diagonals of one template that lie close together are
merged into one span (words may be missing or added between them), and a span is kept when it covers enough of the template.
A phrase template must stand word for word: all its grams on one diagonal.

Defined cases: a null text counts as empty; without words or hits all counts are 0 and the places null; repeated rows each
get their result; a doc_id may be null; other columns of the input are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_GRAMS = 100_000  # the gram table is broadcast only below this many rows; more templates raise an error

# fixed values: the base phrases and their labels
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
# fixed values: opening words of well-known notices
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("cc by sa", "cc-by-sa"), ("cc by nc", "cc-by-nc"), ("cc by nd", "cc-by-nd"),
    ("creative commons attribution", "cc-by"), ("mozilla public license", "mpl"), ("bsd license", "bsd"),
]
COVER = 0.7  # part of a notice's grams that a span must hold
DRIFT = 8    # diagonals of one template this close together belong to one span


def _grams(words: list[str]) -> list[tuple[int, str, str, str | None]]:
    k = min(3, len(words))
    return [(i, words[i], words[i + 1], words[i + 2] if k == 3 else None) for i in range(len(words) - k + 1)]


def templates(spark: SparkSession, phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per gram and template place; its size depends on the templates only."""
    rows = []
    for t, (text, label) in enumerate([*phrases, *notices]):
        grams = _grams(text.split())
        rows += [(t, t < len(phrases), label, len(grams), len(text.split()), *g) for g in grams]
    if len(rows) > MAX_GRAMS:
        raise ValueError(f"{len(rows)} template grams; the broadcast bound is {MAX_GRAMS}")
    made = spark.createDataFrame(rows, "t int, exact boolean, label string, grams int, n int, at int, w0 string, w1 string, w2 string")
    return made.withColumn("gram", F.xxhash64("w0", "w1"))


def lowered(text: Column) -> Column:
    """Lower case in which only A-Z can yield a-z: the two other letters that would are put out of the way first."""
    text = F.coalesce(text, F.lit(""))
    odd = text.contains("\u212a") | text.contains("\u0130")
    return F.lower(F.when(odd, F.translate(text, "\u212a\u0130", "\ue000\ue001")).otherwise(text))


def n_words(parts: Column) -> Column:
    """Words among split parts: a separator at either end leaves an empty part there."""
    return F.greatest(F.lit(0), F.size(parts) - (parts[0] == "").cast("int") - (F.element_at(parts, -1) == "").cast("int")).cast("long")


def spans(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """doc_id, text_key, label, exact, first_word, last_word (both inclusive), cover: every verified span.

    text_key (a hash of the text) tells rows with one doc_id apart.
    """
    spark = docs.sparkSession
    parts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.split(lowered(F.col("text")), SEPARATORS).alias("parts"))
    placed = parts.select("doc_id", "text_key", "parts", (F.col("parts")[0] == "").cast("int").alias("lead"), F.posexplode("parts").alias("pos", "w"))
    second, third = F.get("parts", F.col("pos") + 1), F.get("parts", F.col("pos") + 2)
    grams = placed.where(second.isNotNull()).withColumn("gram", F.xxhash64("w", second))
    known = F.broadcast(templates(spark, phrases, notices))
    same = (F.col("w") == F.col("w0")) & (second == F.col("w1")) & (F.col("w2").isNull() | (third == F.col("w2")))
    hits = grams.join(known, "gram").where(same).select(
        "doc_id", "text_key", "t", "exact", "label", "grams", "n", "at", (F.col("pos") - F.col("lead") - F.col("at")).alias("diagonal"))
    # one row per diagonal: its votes are the distinct template places hit, so repeated rows do not vote twice
    diagonals = hits.groupBy("doc_id", "text_key", "t", "exact", "label", "grams", "n", "diagonal").agg(F.collect_set("at").alias("at"))
    votes = F.size("at")
    order = Window.partitionBy("doc_id", "text_key", "t").orderBy("diagonal")
    near = (
        diagonals.where(~F.col("exact"))
        .withColumn("fresh", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT).cast("int"), F.lit(1)))
        .withColumn("span", F.sum("fresh").over(order))
        .groupBy("doc_id", "text_key", "t", "label", "grams", "n", "span")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("votes"),
             F.min(F.col("diagonal") + F.array_min("at")).cast("long").alias("first_word"),
             F.max(F.col("diagonal") + F.array_max("at")).cast("long").alias("last_gram"))
        .withColumn("cover", F.col("votes") / F.col("grams")).where(F.col("cover") >= COVER)
        .select("doc_id", "text_key", "label", F.lit(False).alias("exact"), "first_word",
                (F.col("last_gram") + F.least(F.col("n"), F.lit(3)) - 1).alias("last_word"), "cover")
    )
    whole = diagonals.where(F.col("exact") & (votes == F.col("grams"))).select(
        "doc_id", "text_key", "label", "exact", F.col("diagonal").cast("long").alias("first_word"),
        (F.col("diagonal") + F.col("n") - 1).cast("long").alias("last_word"), F.lit(1.0).alias("cover"))
    return whole.unionByName(near)


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row per document: word count, places of the phrases, labels and score."""
    base = F.col("exact")
    found = spans(docs, phrases, notices).groupBy("doc_id", "text_key").agg(
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"))
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_key"), n_words(F.split(F.coalesce("text", F.lit("")), SEPARATORS.replace("\\x60", "\\x40\\x5B-\\x60"))).alias("n_words"))
    found = found.withColumnsRenamed({"doc_id": "__doc", "text_key": "__key"})
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_key") == F.col("__key"))
    return counted.join(found, same, "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


