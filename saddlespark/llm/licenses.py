"""License scans: exact phrases, and templates contained in blocks of text.

Phrases are looked up in the normalised text by native string functions.  Templates are found
by a set-similarity join.  A block is a window of ``BLOCK`` words (windows overlap by half, so a
passage of up to ``BLOCK`` / 2 words lies whole in one of them); a template of n distinct words
matches if the block holds at least ``CONTAINS`` of them.  Words are ordered by the number of
documents that have them, rarest first, counted over all documents.  In that order

* prefix: a match must hold one of the first n - need + 1 words of the template,
* length: and at least ``need`` words of it in all,
* position: and after the first common word both sides must still have ``need`` words,

where need = ceil(CONTAINS * n).  What passes is verified by intersection, and by the telling words:
if the words of a template of another label are enough for a match, the block must also hold one
of the words that the other template lacks ("sharealike", "noncommercial").  The index of template
prefixes has a few hundred rows, given by the templates alone, and is therefore broadcast.
Everything is native DataFrame code; only documents with a rare template word get blocks, and
only one small row per different text with a match is joined back.

Cases: a null text is empty: no words, no labels, score 0.  Words are counted over whole texts.
Repeated rows and copies get the same labels; equal scores keep all labels.  Other columns of
the documents are left out.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind

# The phrases that count as base matches.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Sentences of public license notices, in the word form of the scan.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
CONTAINS = 0.8
BLOCK = 96


def normal(text: Column) -> Column:
    """Words in lower case (A-Z only) with one blank before and after each; a blank text is one blank.

    The two characters whose lower case is or begins with an ASCII letter are made another letter first.
    """
    t = F.coalesce(text, F.lit(""))
    for odd in "Kİ":
        t = F.replace(t, F.lit(odd), F.lit("ø"))
    words = F.trim(F.regexp_replace(F.lower(t), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return bind(words, lambda w: F.when(w == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), w, F.lit(" "))))


def blanks(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def places(norm: Column, phrase: str) -> Column:
    """How often a phrase stands in the text, and the first and last word it starts at."""
    p = f" {phrase} "
    first = blanks(F.substr(norm, F.lit(1), F.instr(norm, p) - 1))
    start = F.char_length(norm) - F.instr(F.reverse(norm), p[::-1]) - len(p) + 2
    last = blanks(F.substr(norm, F.lit(1), start - 1))
    there = norm.contains(p)
    return F.struct(
        F.when(there, F.regexp_count(norm, F.lit(f" {phrase}(?= )"))).otherwise(0).cast("long").alias("n"),
        F.when(there, first).cast("long").alias("first"),
        F.when(there, last).cast("long").alias("last"),
    )


def base(norm: Column) -> Column:
    """n_words, n_base, first_word, last_word and the labels of phrases, from a normalised text."""
    found = F.array(*[places(norm, p) for p in PHRASES])
    labels = F.array(*[F.lit(x) for x in PHRASES.values()])
    return bind(
        found,
        lambda f: F.struct(
            (blanks(norm) - 1).cast("long").alias("n_words"),
            F.aggregate(f, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_base"),
            F.array_min(F.transform(f, lambda x: x["first"])).alias("first_word"),
            F.array_max(F.transform(f, lambda x: x["last"])).alias("last_word"),
            F.array_sort(F.array_distinct(F.filter(labels, lambda x, k: F.get(f, k)["n"] > 0))).alias("labels"),
        ),
    )


def words_of(norm: Column) -> Column:
    return F.array_remove(F.split(norm, " ", -1), "")


def frequencies(texts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word of the templates occurs: one row per such word."""
    own = F.array_intersect(words_of(F.col("norm")), F.array(*[F.lit(w) for w in vocabulary]))
    found = texts.select(F.explode(own).alias("w")).groupBy("w").count().collect()
    return {w: 0 for w in vocabulary} | {r["w"]: r["count"] for r in found}


def telling(templates=TEMPLATES, contains: float = CONTAINS) -> list[list[list[str]]]:
    """Per template the sets of words of which a block must hold one each, so as not to be a template of another label."""
    words = [(label, set(t.split())) for label, t in templates]
    return [
        [sorted(own - other) for name, other in words if name != label and len(own & other) >= math.ceil(contains * len(own))]
        for label, own in words
    ]


def matches(texts: DataFrame, templates=TEMPLATES, contains: float = CONTAINS, block: int = BLOCK) -> DataFrame:
    """``key``, the labels of the templates that a block of the text holds, and the best containment."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    seen = frequencies(texts, vocabulary)
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (seen[w], w)))}
    index, rare = [], set()
    for (label, text), sets in zip(templates, telling(templates, contains), strict=True):
        ranks = sorted({rank[w] for w in text.split()})
        tell = [[rank[w] for w in x] for x in sets]
        need = math.ceil(contains * len(ranks))
        for place, r in enumerate(ranks[: len(ranks) - need + 1]):
            index.append((r, label, place, ranks, need, tell))
            rare.add(r)
    spark = texts.sparkSession
    prefixes = spark.createDataFrame(index, "rank int, label string, place int, ranks array<int>, need int, tell array<array<int>>")
    lookup = F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)])
    rare_words = F.array(*[F.lit(w) for w, r in rank.items() if r in rare])
    docs = texts.select("key", words_of(F.col("norm")).alias("w")).filter(F.arrays_overlap("w", rare_words))
    step = block // 2
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1 - step, F.lit(0)), F.lit(step))
    blocks = docs.select("key", "w", F.explode(starts).alias("at")).select("key", F.slice("w", F.col("at") + 1, F.lit(block)).alias("w"))
    ranks = F.array_sort(F.array_distinct(F.filter(F.transform("w", lambda x: F.element_at(lookup, x)), lambda x: x.isNotNull())))
    blocks = blocks.select("key", ranks.alias("have"))
    tokens = blocks.select("key", "have", F.posexplode("have").alias("at", "rank"))
    pairs = tokens.join(F.broadcast(prefixes), "rank")
    pairs = pairs.filter(F.size("have") >= F.col("need"))
    pairs = pairs.filter(F.least(F.size("ranks") - F.col("place"), F.size("have") - F.col("at")) >= F.col("need"))
    common = F.array_intersect("have", "ranks")
    pairs = pairs.withColumn("common", F.size(common)).filter(F.col("common") >= F.col("need"))
    pairs = pairs.filter(F.forall("tell", lambda x: F.arrays_overlap(x, F.col("have"))))
    found = pairs.select("key", "label", (F.col("common") / F.size("ranks")).alias("share"))
    return found.groupBy("key").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: places of the phrases, all labels, score.

    Labels of templates depend on the text alone and are joined by two digests of it.
    """
    texts = docs.select("doc_id", normal(F.col("text")).alias("norm"))
    key = F.struct(F.xxhash64("norm").alias("a"), F.hash("norm").alias("b"), F.octet_length("norm").alias("c"))
    texts = texts.withColumn("key", key)
    rows = texts.select("doc_id", "key", base(F.col("norm")).alias("b"))
    all_rows = rows.join(matches(texts), "key", "left")
    labels = F.array_sort(F.array_union("b.labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.size("b.labels") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return all_rows.select(
        "doc_id",
        "b.n_words",
        "b.n_base",
        "b.first_word",
        "b.last_word",
        F.array_join("b.labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
    )
