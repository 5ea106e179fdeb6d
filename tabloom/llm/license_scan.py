"""License scan by diagonal voting, in DataFrame functions only.

All rolling word k-gram hashes of a text are joined to the places where the
templates have them. A match votes for its diagonal, text position less template
position; votes are summed by diagonal, diagonals that lie near each other merge
(words put in or left out shift a passage to a neighbour), and the words of each
merged span are compared with the template's. Templates of which enough is found
give their label: the part of a template's words that stand on the diagonals of a
span, in place. Votes alone drop a span only where they show that this part is
too small. A template too short to keep a k-gram with as many words replaced as
the coverage allows votes by shorter grams.

Beside it, short phrases are counted wherever their words stand in a row.

Defined results: a null or empty text has no words, no labels and score 0; rows
that repeat each give their own result; an empty table gives no rows; columns
beyond doc_id and text are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.llm.common import Store

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public notices as their publishers word them.
TEMPLATES = [
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

K = 3
#: Diagonals at most so far apart merge.
NEAR = 3
#: Part of a template's words that a span must have.
COVERAGE = 0.8


def words(text: Column | str) -> Column:
    """Words of a text, lower case; beyond A-Z lower case only changes letters within words."""
    lower = F.lower(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")))
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def grams(ws: str, k: int) -> Column:
    """The hash of the k words from each place on."""
    each = F.transform(ws, lambda w, i: F.xxhash64(w, *(F.get(F.col(ws), i + j) for j in range(1, k))))
    return F.slice(each, 1, F.greatest(F.size(ws) - (k - 1), F.lit(0)))


def places(ws: str, phrase: list[str]) -> Column:
    """Where the phrase's words stand in a row."""

    def all_there(i: Column) -> Column:
        there = i.isNotNull()
        for j, word in enumerate(phrase[1:], 1):
            there = there & (F.get(F.col(ws), i + j) == word)
        return there

    at = F.filter(F.transform(ws, lambda w, i: F.when(w == phrase[0], i)), all_there)
    return F.when(F.array_contains(ws, phrase[-1]), at).otherwise(F.array().cast("array<int>"))


def may_miss(n: int, coverage: float) -> int:
    """How many of n words can be other ones, where the coverage is kept."""
    return max(m for m in range(n + 1) if m == 0 or (n - m) / n >= coverage)


def has_words_of(held: str, templates: list[list[str]], coverage: float) -> Column:
    """Whether the distinct words in ``held`` leave any template its coverage, wherever they stand.

    Words found in place are words of the text, so no text that a template is found in is left out.
    """
    enough = []
    for ws in templates:
        distinct = sorted(set(ws))
        enough.append(F.size(F.array_intersect(held, F.array(*map(F.lit, distinct)))) >= len(distinct) - may_miss(len(ws), coverage))
    return reduce(or_, enough, F.lit(False))


def votes_due(n: int, k: int, coverage: float) -> tuple[int, int]:
    """Words of a gram by which a template of n words votes, and the votes it has at least on one diagonal that holds the coverage.

    A replaced word costs a gram's length of votes at most; grams are as long as
    leaves a vote, and of ``k`` words at most.
    """
    missing = may_miss(n, coverage)
    due = {size: n - size + 1 - size * missing for size in range(k, 0, -1)}
    return next(((size, least) for size, least in due.items() if least > 0), (1, 1))


def template_table(spark: SparkSession, templates: list[tuple[str, str]], k: int, coverage: float) -> DataFrame:
    """template, label, twords, gram and due (of ``votes_due``), and h, tpos for each gram."""
    rows = [(i, label, text) for i, (label, text) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, label string, text string").select("template", "label", words("text").alias("twords"))
    rows = [(*r, *votes_due(len(r.twords), k, coverage)) for r in table.collect() if r.twords]
    table = spark.createDataFrame(rows, "template int, label string, twords array<string>, gram int, due int")
    each = F.coalesce(*(F.when(F.col("gram") == size, grams("twords", size)) for size in range(1, k + 1)))
    return table.select("*", F.posexplode(each).alias("tpos", "h"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, k: int = K, near: int = NEAR, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    ``spans`` holds label, start, end (word positions) and the part of the
    template that was found. The templates' k-grams are the caller's fixed list
    and travel by broadcast; texts stay where they are read, and only documents
    that hold a k-gram and, somewhere, enough of the words of a template take part in the join.
    """
    spark, store = docs.sparkSession, Store(docs.sparkSession, "license-scan")
    table = template_table(spark, templates, k, coverage)
    wanted: dict[int, list[int]] = {}
    for r in table.select("gram", "h").distinct().collect():
        wanted.setdefault(r.gram, []).append(r.h)
    twords = [r.twords for r in table.select("template", "twords").distinct().collect()]
    known = F.array_intersect("ws", F.array(*map(F.lit, sorted({w for ws in twords for w in ws}))).cast("array<string>"))
    # most texts end at their words, before a gram is hashed
    hit = has_words_of("known", twords, coverage) & reduce(or_, (F.arrays_overlap(grams("ws", size), F.array(*map(F.lit, hs))) for size, hs in sorted(wanted.items())), F.lit(False))
    read = docs.select(F.xxhash64("text").alias("_k"), F.xxhash64("doc_id", "text", F.lit(k)).alias("_d"), "doc_id", words("text").alias("ws"))
    found = F.concat(*(places("ws", p.split()) for p in phrases))
    labels = F.array_compact(F.array(*(F.when(F.size(places("ws", p.split())) > 0, F.lit(label)) for p, label in phrases.items())))
    base = store.keep(
        read.withColumn("known", known)
        .withColumn("hit", hit)
        .withColumn("at", F.when(F.array_contains("ws", "license") if all("license" in p.split() for p in phrases) else F.lit(True), found))
        .select(
            "_k",
            "_d",
            "doc_id",
            F.size("ws").cast("long").alias("n_words"),
            F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_base"),
            F.array_min("at").cast("long").alias("first_word"),
            F.array_max("at").cast("long").alias("last_word"),
            F.when(F.size("at") > 0, F.sort_array(F.array_distinct(labels))).otherwise(F.array().cast("array<string>")).alias("base"),
            F.when(F.col("hit"), F.col("ws")).alias("ws"),
        ),
        "base",
    )
    key = ["_k", "_d"]
    candidates = base.where("ws is not null").select(*key, "ws")
    held = (candidates.select(*key, F.lit(size).alias("gram"), F.posexplode(grams("ws", size)).alias("pos", "h")) for size in sorted(wanted) or [k])
    votes = (
        reduce(DataFrame.unionByName, held)
        .join(F.broadcast(table.select("gram", "h", "template", "tpos")), ["gram", "h"])
        .groupBy(*key, "template", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        .agg(F.count_distinct("tpos").alias("votes"))
    )
    by = W.partitionBy(*key, "template").orderBy("diagonal")
    merged = (
        votes.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > near).cast("int"), F.lit(1)))
        .withColumn("span", F.sum("new").over(by))
        .groupBy(*key, "template", "span")
        .agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals"), F.sum("votes").alias("votes"))
    )
    whole = table.select("template", "label", "twords", "due").distinct()
    # on one diagonal the coverage needs that many votes; on several, words may change between them at any place
    likely = merged.join(F.broadcast(whole), "template").where((F.size("diagonals") > 1) | (F.col("votes") >= F.col("due")))
    same = F.transform("twords", lambda w, i: F.exists("diagonals", lambda d: (i + d >= 0) & F.coalesce(F.get(F.col("ws"), F.greatest(i + d, F.lit(0))) == w, F.lit(False))))
    verified = (
        likely.join(candidates.dropDuplicates(key), key)
        .withColumn("part", F.size(F.filter(same, lambda x: x)) / F.size("twords"))
        .where(F.col("part") >= coverage)
        .select(
            *key,
            F.struct(
                "label",
                F.greatest(F.element_at("diagonals", 1), F.lit(0)).cast("long").alias("start"),
                F.least(F.element_at("diagonals", -1) + F.size("twords"), F.size("ws")).cast("long").alias("end"),
                "part",
            ).alias("span"),
        )
    )
    spans = verified.groupBy(*key).agg(F.sort_array(F.collect_set("span")).alias("spans"))
    none = F.array().cast("array<struct<label:string,start:bigint,end:bigint,part:double>>")
    joined = base.drop("ws").join(spans, key, "left").withColumn("spans", F.coalesce("spans", none))
    own = F.transform("spans", lambda s: s["label"])
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat("base", own))), ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("spans", lambda s: s["part"])), F.lit(0.0))).alias("score"),
        "spans",
    )
