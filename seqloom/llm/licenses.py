"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

A block is a stretch of a text's words, across lines and sentences, that is at most
1 / ``threshold`` times as long as the template it is held against.  A template is met if a
block holds at least ``threshold`` of its distinct words.  Template words are ordered by
their frequency in the whole corpus, rarest first.

* Prefix filter, the join key: a block that meets a template holds one of its rarest words.
  An index from such words to templates, made of the whole template list, is searched with
  each text's words; only the templates found go on, so a text costs nothing for the others.
* Length filter: a text needs enough of a template's distinct words in all.
* Positional filter: a block starts at one of the template's words, and enough more of them
  must stand within its length.

What passes is verified by counting.  The templates, sentences as well as whole bodies, are a
parameter of bounded size, so the index travels in the plan and the texts are never shuffled.
DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import columns
from .license_texts import BODIES
from .url_reputation import LOWER, UPPER

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: str) -> str:
    """A template's words as ``normal`` makes those of a text."""
    return re.sub(BREAK, " ", text.translate(str.maketrans(UPPER, LOWER))).strip(" ")


#: Phrases of the base rules, and sentences that name a license (lower-case
#: words).  A notice that differs from another's in one word of many is no sentence of its own.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
SENTENCES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)
#: The method's templates: those sentences, and whole bodies of licenses.
TEMPLATES = SENTENCES + tuple((label, plain_words(body)) for label, body in BODIES)
THRESHOLD = 0.9


def normal(text: Column) -> Column:
    """A-Z lower-cased words with one space between them."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK, " "))


def needed(words: int, threshold: float) -> int:
    """Distinct words of a template that a block must hold."""
    return math.ceil(threshold * words - 1e-9)


def width(words: int, threshold: float) -> int:
    """Words of the longest block for a template of so many words."""
    return math.ceil(words / threshold - 1e-9)


def _spaces(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")


def _strings(values: Sequence[str]) -> Column:
    """Words (without spaces) as one literal."""
    return F.split(F.lit(" ".join(values)), " ")


def word_frequencies(words: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many texts each word of a short vocabulary stands.  ``words``: one array column."""
    met = words.select(F.explode(F.array_intersect(F.col("words"), _strings(vocabulary))).alias("w"))
    return {r["w"]: r["count"] for r in met.groupBy("w").count().collect()}  # the vocabulary at most


def _most_in_a_block(words: Column, t: Column) -> Column:
    """The most distinct words of template ``t`` in a block of the text, 0 if too few."""

    def best(hits: Column) -> Column:  # the template's words in the text, with their places
        def of(first: Column, j: Column) -> Column:
            end = first["at"] + t["width"]
            near = F.get(hits, j + (t["need"] - 1))["at"] < end
            inside = F.filter(F.slice(hits, j + 1, t["width"]), lambda h: h["at"] < end)
            return F.when(near, F.size(F.array_distinct(F.transform(inside, lambda h: h["word"])))).otherwise(0)

        return F.array_max(F.transform(hits, of))

    places = F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    hits = F.filter(places, lambda p: F.array_contains(t["words"], p["word"]))
    most = F.element_at(F.transform(F.array(hits), best), 1)  # an array of one: hits are found once
    return F.when(most >= t["need"], most).otherwise(0)


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of all phrases; first_word and last_word are the smallest and
    largest word index at which one starts (null: none).  labels joins base labels and those
    of the templates met; score is 1 with a phrase, else the largest share of a met
    template's words in a block, else 0.

    A null text is empty and has no words; texts are taken whole, however long; repeated rows
    are scanned each; an empty table gives an empty one.  Other columns are ignored.
    """
    base = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), normal(F.col("text")).alias("t"))
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    often = word_frequencies(base.select(F.split("t", " ").alias("words")), vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}
    index: dict[str, list[int]] = {}
    listed = []
    for i, (label, t) in enumerate(templates):
        words = sorted(set(t.split()), key=rank.__getitem__)
        need = needed(len(words), threshold)
        for w in words[: len(words) - need + 1]:
            index.setdefault(w, []).append(i)
        fields = [F.lit(label).alias("label"), _strings(words).alias("words"), F.lit(need).alias("need"), F.lit(width(len(t.split()), threshold)).alias("width")]
        listed.append(F.struct(*fields))

    padded = F.concat(F.lit(" "), F.col("t"), F.lit(" "))
    d = base.withColumn("p", padded)
    n_base, firsts, lasts, found = F.lit(0).cast("long"), [], [], []
    for label, phrase in PHRASES:
        there = F.col("p").contains(f" {phrase} ")
        n_base = n_base + F.when(there, F.regexp_count("p", F.lit(f" {phrase}(?= )"))).otherwise(0)
        firsts.append(F.when(there, _spaces(F.substring(F.col("p"), F.lit(1), F.instr(F.col("p"), f" {phrase} "))) - 1))
        from_end = F.instr(F.reverse("p"), f" {phrase} "[::-1])
        lasts.append(F.when(there, _spaces(F.substring(F.col("p"), F.lit(1), F.length("p") - from_end - len(phrase))) - 1))
        found.append(F.when(there, F.lit(label)))
    base_set = F.array_compact(F.array(*found))

    none = F.array().cast("array<struct<label:string,share:double>>")
    met = none
    if listed:
        # Templates whose prefix words the text holds, from the index.
        keys = F.array_intersect(F.split("t", " "), _strings(sorted(index)))
        by_word = F.create_map(*[x for w in sorted(index) for x in (F.lit(w), F.array(*map(F.lit, index[w])))])
        candidates = F.array_distinct(F.flatten(F.transform("keys", lambda w: F.element_at(by_word, w))))
        d = d.withColumn("keys", keys)
        d = d.withColumn("words", F.when(F.size("keys") > 0, F.split("t", " "))).withColumn("found", F.array_intersect(F.col("words"), _strings(vocabulary)))
        tried = F.transform(candidates, lambda i: F.get(F.array(*listed), i))
        enough = F.filter(tried, lambda t: F.size(F.array_intersect(F.col("found"), t["words"])) >= t["need"])
        shares = F.transform(enough, lambda t: F.struct(t["label"].alias("label"), (_most_in_a_block(F.col("words"), t) / F.size(t["words"])).alias("share")))
        met = F.when(F.size("keys") > 0, F.filter(shares, lambda s: s["share"] > 0)).otherwise(none)
    d = d.withColumn("met", met)
    n_words = F.when(F.col("t") == "", F.lit(0).cast("long")).otherwise(_spaces(F.col("t")) + 1)
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return d.select(
        "doc_id",
        n_words.alias("n_words"),
        n_base.alias("n_base"),
        F.array_min(F.array(*firsts)).alias("first_word"),
        F.array_max(F.array(*lasts)).alias("last_word"),
        joined(base_set).alias("base_labels"),
        joined(F.concat(base_set, F.col("met.label"))).alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("met.share"), F.lit(0.0))).alias("score"),
    )
