"""Scanning texts for license names and notices by diagonal voting. Only DataFrame functions are used.

A-Z are lower-cased, words are the longest runs of digits, letters a-z and characters beyond ASCII. Every
rolling gram of a text meets the grams of the templates by a join on its 64-bit hash; the words behind equal
hashes are compared. A hit at word ``pos`` of the text and word ``at`` of a template votes for the diagonal
``pos - at``, where the template would start.

Names (``exact``) are looked for with grams of two words: a place counts if all grams of the name vote for
one diagonal, so its words stand consecutively. Notices are looked for with grams of four words: diagonals
of one notice that lie near each other (words were put in or left out between them) are merged to a span,
and a span is verified by the notice's words that its grams cover, over the length of the notice or the
span, whichever is longer.

The texts are read once and never shuffled. Templates are few and of fixed size, so their grams are
broadcast. All later steps are keyed by row, so a passage that many documents share makes no hot key.

Nulls: a null text counts as empty, a null doc_id is kept as it is. Texts without words have no spans.
Each row stands for itself, also if others are equal to it. Other columns, also with names used here, are
not read. Spans that tie are in the order of their start, end, label. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.rows import text_of

NAME_GRAM, NOTICE_GRAM = 2, 4
#: What a notice's span must reach, and how many words may be put in or left out between two of its diagonals.
LEAST_SCORE = 0.8
DRIFT = 8
#: Templates are broadcast; beyond this many words Spark joins them as it sees fit.
BROADCAST_WORDS = 200_000


class Template(NamedTuple):
    label: str
    text: str
    exact: bool = False


# Names of licenses and the words of their usual notices.
TEMPLATES = [
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files (the \"Software\"), to deal in the Software without restriction"),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
             "compliance with the License. You may obtain a copy of the License at"),
    Template("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
             "the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
             "the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
             "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc-by", "licensed under CC BY 4.0"),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0"),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def rolling(texts: DataFrame, *keep: str) -> DataFrame:
    """``keep``, ``n_words``, and for every word its position ``pos`` and the words ``w0`` to ``w3`` from there on.

    ``w1`` to ``w3`` are null beyond the end; a text without words gives one row without a position.
    """
    cut = texts.select(*keep, words_of(text_of()).alias("w0")).withColumn("n_words", F.size("w0"))
    later = [F.slice("w0", k + 1, F.col("n_words")).alias(f"w{k}") for k in range(1, NOTICE_GRAM)]
    rolled = cut.select(*keep, "n_words", "w0", *later).select(
        *keep, "n_words", F.arrays_zip(*[f"w{k}" for k in range(NOTICE_GRAM)]).alias("z"))
    return rolled.select(*keep, "n_words", F.posexplode_outer("z").alias("pos", "g")).select(*keep, "n_words", "pos", "g.*")


def gram_hash(size: int) -> Column:
    return F.xxhash64(*[f"w{k}" for k in range(size)])


def template_grams(spark: SparkSession, templates: list[Template], exact: bool) -> DataFrame:
    """(h, t0, t1, ...: the gram, places: where in which template it stands), one row for each gram."""
    size = NAME_GRAM if exact else NOTICE_GRAM
    rows = json.dumps([{"template": i, "label": t.label, "text": t.text} for i, t in enumerate(templates) if t.exact == exact])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<template:int,label:string,text:string>>")))
    gram = [f"w{k}" for k in range(size)]
    place = F.struct("template", "label", F.col("n_words").alias("length"), F.lit(exact).alias("exact"), F.col("pos").alias("at"))
    return (
        rolling(table, "template", "label").filter(F.col(gram[-1]).isNotNull())
        .groupBy(*gram).agg(F.collect_list(place).alias("places"))
        .select(gram_hash(size).alias(f"h{size}"), *[F.col(g).alias(f"t{size}{k}") for k, g in enumerate(gram)],
                F.col("places").alias(f"places{size}")))


def hits(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """(row, doc_id, n_words, pos, template, label, length, exact, at): one row for each gram of a text that
    stands in a template, and at least one row for every text, without a template."""
    found = rolling(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "row", "doc_id")
    places = []
    few = sum(len(t.text) for t in templates) < BROADCAST_WORDS
    for size, exact in ((NAME_GRAM, True), (NOTICE_GRAM, False)):
        table = template_grams(docs.sparkSession, templates, exact)
        found = found.withColumn(f"h{size}", gram_hash(size)).join(F.broadcast(table) if few else table, f"h{size}", "left")
        same = F.lit(True)
        for k in range(size):
            same = same & (F.col(f"w{k}") == F.col(f"t{size}{k}"))
        # The condition is false, not null, for every row without a partner.
        places.append(F.when(F.coalesce(same, F.lit(False)), F.col(f"places{size}")).otherwise(F.expr(f"slice(places{size}, 1, 0)")))
    none = F.expr("cast(array() as array<struct<template:int,label:string,length:int,exact:boolean,at:int>>)")
    both = F.concat(*[F.coalesce(p, none) for p in places])
    return (
        found.select("row", "doc_id", "n_words", "pos", both.alias("places"))
        .filter("size(places) > 0 OR pos IS NULL OR pos = n_words - 1")
        .select("row", "doc_id", "n_words", "pos", F.explode_outer("places").alias("p")).select("row", "doc_id", "n_words", "pos", "p.*"))


def diagonals(found: DataFrame) -> DataFrame:
    """Votes of each diagonal: (row, doc_id, n_words, template, label, length, exact, start, ats, low, high).

    ``ats`` are the template positions that voted, ``low`` and ``high`` the text positions of the first and last.
    """
    return found.groupBy(
        "row", "doc_id", "n_words", "template", "label", "length", "exact", (F.col("pos") - F.col("at")).alias("start")
    ).agg(F.collect_set("at").alias("ats"), F.min("pos").alias("low"), F.max("pos").alias("high"))


def merged(lines: DataFrame) -> DataFrame:
    """Spans of neighbouring diagonals. Names keep their diagonals apart; rows without a template stay one row a text."""
    order = Window.partitionBy("row", "template").orderBy("start")
    near = F.least(F.lit(DRIFT), F.floor(F.col("length") / 2))
    fresh = F.coalesce(F.col("exact") | (F.col("start") - F.lag("start").over(order) > near), F.lit(True))
    return (
        lines.withColumn("fresh", fresh.cast("int"))
        .withColumn("span", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "doc_id", "n_words", "template", "label", "length", "exact", "span")
        .agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("low").alias("low"), F.max("high").alias("high")))


def scan(docs: DataFrame, templates: list[Template] | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, n_words, spans) for every row of ``docs``; spans: array of (start, end, label, exact, score), in order.

    ``start`` is the first word, ``end`` the word after the last. Names score 1, notices the share that was found.
    """
    spans = merged(diagonals(hits(docs, TEMPLATES if templates is None else templates)))
    size = F.when(F.col("exact"), NAME_GRAM).otherwise(NOTICE_GRAM)
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("size") - 1)))))
    scored = (
        spans.withColumn("size", size).withColumn("end", F.col("high") + F.col("size"))
        .withColumn("score", covered / F.greatest(F.col("length"), F.col("end") - F.col("low"))))
    kept = F.when(F.col("exact"), F.col("score") == 1.0).otherwise(F.col("score") >= least)
    span = F.struct(F.col("low").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "label", "exact", "score")
    return (
        scored.groupBy("row", "doc_id", "n_words").agg(F.sort_array(F.collect_list(F.when(kept, span))).alias("spans"))
        .select("doc_id", F.col("n_words").cast("long").alias("n_words"), "spans"))
