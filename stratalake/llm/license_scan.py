"""License scans by diagonal voting.

Templates (short phrases and license notices) are cut into rolling word k-grams. The 64-bit hashes of all k-grams of all whole
texts are joined in Spark to the template positions, and the words of a match are compared, so that hashes that happen to be
equal don't count; a match votes for the diagonal (place in the text minus place in the template). Votes are gathered by text,
template and diagonal, neighbouring diagonals are merged (words put in or left out), and each merged span is verified by the
template positions that it holds, each counted once: a phrase must stand there in full, a notice with a share of its k-grams.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What stands between words: ASCII but for digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False  # a phrase: every full occurrence counts


#: The phrases and their labels.
BASE = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)
#: Public notices; the part of each that doesn't change from work to work.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("gpl-licensed", "this work is licensed under the gnu general public license version 3"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
)
GRAM = 4


def _words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def _positions(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(template, base, n_grams, at, gram, k, hash): every rolling k-gram of every template; k is 2 at most for phrases, GRAM for notices."""
    rows = []
    for t in templates:
        words = t.text.split()
        k = _size(t)
        rows += [(t.label, t.base, len(words) - k + 1, i, words[i : i + k]) for i in range(len(words) - k + 1)]
    grams = spark.createDataFrame(rows, "template string, base boolean, n_grams int, at int, gram array<string>").withColumn("k", F.size("gram"))
    # the hash of a gram is that of its halves' hashes, as for texts
    hashed = None
    for k in sorted({_size(t) for t in templates}):
        parts = [F.xxhash64(F.col("gram")[i]) for i in range(k)]
        while len(parts) > 1:
            parts = [F.xxhash64(a, b) for a, b in zip(parts[::2], parts[1::2], strict=True)]
        part = grams.where(F.col("k") == k).withColumn("hash", parts[0])
        hashed = part if hashed is None else hashed.unionByName(part)
    return hashed


def _size(t: Template) -> int:
    """The size of a template's grams: a power of two, GRAM at most."""
    return min(2 if t.base else GRAM, 1 << (len(t.text.split()).bit_length() - 1))


def license_scan(spark: SparkSession, docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, gap: int = 3, share: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places where a phrase's words stand in full, first_word and last_word are the least and greatest of
    these starts (words from 0; null without any). labels adds the notices of which a share of the k-grams lies on one
    diagonal or on diagonals at most gap apart; score is the greatest share of any template found, 0 without any.
    Null and empty texts have no words; of a very long text, a task holds the hashes of its grams (16 bytes a word and size).
    A notice that a text repeats with more than gap words between counts as spans of their own, of which one must suffice. Repeated rows and null ids are rows of their own (a row number by hash and partition
    isn't needed: equal (id, text) rows have equal results and are joined as one). Other columns are ignored, whatever their
    names; an empty table gives an empty one. The templates are a parameter of bounded size and are broadcast.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), _words(F.col(text_col)).alias("words"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"))
    grams = F.broadcast(_positions(spark, templates))
    base = {t.label for t in templates if t.base}
    sizes = sorted({_size(t) for t in templates})
    # the hashes of k-grams for k = 1, 2, 4, ..., each from two of the size before; the last ones, which run out of the text, are null
    hashed, k = docs.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w))), 1
    while k < max(sizes):
        h = F.col(f"h{k}")
        after = F.slice(h, F.lit(k + 1), F.greatest(F.size(h) - k, F.lit(0)))
        hashed = hashed.withColumn(f"h{2 * k}", F.zip_with(h, after, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.xxhash64(a, b))))
        k *= 2
    places = hashed.select("doc_id", "mark", "words", F.posexplode(F.concat(*(F.col(f"h{k}") for k in sizes))).alias("place", "hash")).where("hash IS NOT NULL")
    # a text's grams of one size stand behind those of the size before, as many as it has words
    places = places.withColumn("place", F.pmod("place", F.size("words")))
    found = places.join(grams, "hash").where(F.slice("words", F.col("place") + 1, F.col("k")) == F.col("gram"))
    votes = found.groupBy("doc_id", "mark", "template", "base", "n_grams", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))
    # merge neighbouring diagonals of a notice: a new span begins where the step to the next one is wider than gap
    ordered = Window.partitionBy("doc_id", "mark", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(ordered)
    spans = votes.withColumn("span", F.sum(F.when(F.col("base") | step.isNull() | (step > gap), 1).otherwise(0)).over(ordered))
    spans = spans.groupBy("doc_id", "mark", "template", "base", "n_grams", "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("votes"), F.min("diagonal").alias("start"))
    spans = spans.where((F.col("base") & (F.col("votes") == F.col("n_grams"))) | (~F.col("base") & (F.col("votes") >= share * F.col("n_grams"))))
    is_base = F.col("template").isin(*base)
    marks = spans.groupBy("doc_id", "mark").agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).alias("last_word"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(is_base, F.col("template"))))).alias("base_labels"),
        F.concat_ws(",", F.sort_array(F.collect_set("template"))).alias("labels"),
        F.max(F.col("votes") / F.col("n_grams")).alias("score"),
    )
    rows = docs.select("doc_id", "mark", F.size("words").cast("long").alias("n_words"))
    same = [rows["mark"] == marks["mark"], rows["doc_id"].eqNullSafe(marks["doc_id"])]
    return rows.join(marks, same, "left").select(
        rows["doc_id"],
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce(F.col("score"), F.lit(0.0)).alias("score"),
    )
