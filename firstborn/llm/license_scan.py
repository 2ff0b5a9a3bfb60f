"""Licence scan by a positional index of rare words, in DataFrame functions only.

Templates are short licence texts with key phrases that must stand in them.  The index lists,
for every template, its rarest words over the corpus (fewest documents first) and their
positions, and all words of the key phrases.  A file looks up its own rarest index words; every
occurrence votes for the place where a template would start, votes for one start are summed,
and a start counts only if all key phrases stand at their places from there.  A key phrase is
found the same way: all of its words vote for one start.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import persist_reliably
from .common import whole_text

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words are maximal runs of other characters: ASCII letters in lower case, digits, all beyond ASCII.
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Labels of phrases that name a licence by themselves.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, text and key phrases of licence notices.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        ("hereby granted free of charge", "deal in the software without restriction"),
    ),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("gpl", "this work is licensed under the gnu general public license version", ("gnu general public license",)),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        ("gnu general public license", "free software foundation"),
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
        "general public license as published by the free software foundation",
        ("gnu lesser general public license",),
    ),
    ("lgpl", "licensed under the gnu lesser general public license version", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license version", ("gnu affero general public license",)),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        ("source and binary forms", "following conditions are met"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("any purpose with or without fee",),
    ),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
    ("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("unencumbered software", "into the public domain"),
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    (
        "cc-by",
        "licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution 4",),
    ),
    (
        "cc-by-nc",
        "licensed under a creative commons attribution noncommercial 4 0 international license",
        ("creative commons attribution noncommercial",),
    ),
    (
        "cc-by-sa",
        "licensed under a creative commons attribution sharealike 4 0 international license",
        ("creative commons attribution sharealike",),
    ),
)

#: The rarest words of a template that are indexed, and of a file that are looked up.
RAREST = 8
LOOKED_UP = 24
#: The share of its indexed weight that must stand at a start for a template's label.
LEAST_SHARE = 0.6


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, UPPER.lower()), BREAK), "")


def phrases() -> list[str]:
    """All phrases, base ones first; their places in the list are their numbers."""
    keys = [p for _, _, keys in TEMPLATES for p in keys]
    return list(dict.fromkeys([p for p, _ in BASE] + keys))


def vocabulary() -> list[str]:
    return sorted({w for text in [*phrases(), *(t for _, t, _ in TEMPLATES)] for w in text.split()})


@dataclass(frozen=True)
class RareIndex:
    """What one corpus makes of the fixed templates; its size does not follow the corpus.

    ``postings`` has (template, word, at, weight), ``words`` all looked-up words, rarest first.
    """

    postings: list[tuple[int, str, int, float]]
    words: list[str]


def template_index(documents: int, counts: dict[str, int]) -> RareIndex:
    """Index of the RAREST words of every template by document counts; ties in order of the word."""
    rarity = lambda w: (counts.get(w, 0), w)
    postings, used = [], {w for p in phrases() for w in p.split()}
    for t, (_, text, _) in enumerate(TEMPLATES):
        words = text.split()
        rare = sorted(set(words), key=rarity)[:RAREST]
        used |= set(rare)
        weight = {w: log(1 + max(documents, 1) / (1 + counts.get(w, 0))) for w in rare}
        postings += [(t, w, at, weight[w]) for at, w in enumerate(words) if w in weight]
    return RareIndex(postings, sorted(used, key=rarity))


def count_words(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Documents, and documents that have each word of the vocabulary: one number per word reaches the driver."""
    known = F.array(*[F.lit(w) for w in vocabulary()])
    found = docs.select(F.array_intersect(split_words(whole_text()), known).alias("w"))
    counts = found.select(F.explode(F.array_append("w", F.lit(""))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    counts = {r.w: r.n for r in counts.collect()}  # at most as many rows as the vocabulary has words, and one
    return counts.pop("", 0), counts


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def look_up(docs: DataFrame, index: RareIndex) -> DataFrame:
    """row, doc_id, n_words and hits (word, at) of every document, as a table.

    A document looks up its LOOKED_UP rarest index words and the words of key phrases; one
    without all words of any phrase has no hits, for no template can stand in it.
    """
    needs = [sorted(set(p.split())) for p in phrases()]
    words = docs.select("doc_id", split_words(whole_text()).alias("words"))
    known = words.withColumn("own", F.array_intersect(_strings(index.words), F.array_intersect("words", _strings(index.words))))
    possible = F.lit(False)
    for need in needs:
        possible = possible | (F.size(F.array_intersect("own", _strings(need))) == len(need))
    keys = sorted({w for need in needs for w in need})
    looked = F.array_union(F.slice("own", 1, LOOKED_UP), F.array_intersect("own", _strings(keys)))
    known = known.withColumn("looked", F.when(possible, looked))
    placed = F.transform("words", lambda w, i: F.struct(w.alias("word"), i.cast("bigint").alias("at")))
    hits = F.when(F.col("looked").isNotNull(), F.filter(placed, lambda x: F.array_contains("looked", x["word"])))
    return persist_reliably(
        known.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("bigint").alias("n_words"), hits.alias("hits"))
    )


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of fixed size, made from the templates."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def phrase_places(hits: DataFrame) -> DataFrame:
    """row, phrase and start of every place where all words of a phrase stand in order."""
    numbered = [(p, w, k, len(text.split())) for p, text in enumerate(phrases()) for k, w in enumerate(text.split())]
    words = _small(hits.sparkSession, numbered, "phrase int, word string, offset int, length int")
    votes = hits.join(words, "word").select("row", "phrase", (F.col("at") - F.col("offset")).alias("start"), "length")
    # A word of the file is one vote for a start and phrase at most, so votes need no distinct.
    return votes.groupBy("row", "phrase", "start").agg(F.count("*").alias("n"), F.first("length").alias("length")).filter("n = length").select("row", "phrase", "start")


def template_starts(hits: DataFrame, places: DataFrame, index: RareIndex) -> DataFrame:
    """row, template, start and share of every start from which all key phrases stand at their places."""
    spark = hits.sparkSession
    totals: dict[int, float] = {}
    for t, _, _, weight in index.postings:
        totals[t] = totals.get(t, 0.0) + weight
    postings = _small(spark, [(t, w, at, v / totals[t]) for t, w, at, v in index.postings], "template int, word string, offset int, weight double")
    votes = hits.join(postings, "word").select("row", "template", (F.col("at") - F.col("offset")).alias("start"), "weight")
    shares = votes.groupBy("row", "template", "start").agg(F.sum("weight").alias("share"))
    numbers = {p: i for i, p in enumerate(phrases())}
    keys = [
        (t, numbers[p], len(text[: f" {text} ".index(f" {p} ")].split()), len(wanted))
        for t, (_, text, wanted) in enumerate(TEMPLATES)
        for p in wanted
    ]
    keyed = _small(spark, keys, "template int, phrase int, offset int, wanted int")
    met = places.join(keyed, "phrase").select("row", "template", (F.col("start") - F.col("offset")).alias("start"), "wanted")
    whole = met.groupBy("row", "template", "start").agg(F.count("*").alias("n"), F.first("wanted").alias("wanted")).filter("n = wanted")
    return shares.join(whole.select("row", "template", "start"), ["row", "template", "start"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of every row.

    Places of base phrases are all found: n_base counts them, first_word and last_word are the
    least and greatest start, from 0, null without one.  Labels are distinct and in order,
    joined by commas: those of base phrases, and of templates with a start of share LEAST_SHARE
    or more.  Score is the greatest share of a start whose key phrases stand, rounded to 6
    digits, 0 without one.  Spans lists those starts (label, start, share).

    A null text has no words; rows with equal or null doc_id stay apart; no rows give none;
    other columns are ignored.
    """
    spark = docs.sparkSession
    index = template_index(*count_words(docs))
    files = look_up(docs, index)
    hits = files.filter("size(hits) > 0").select("row", F.explode("hits").alias("h")).select("row", "h.*")
    places = persist_reliably(phrase_places(hits))
    starts = template_starts(hits, places, index)
    base = _small(spark, [(i, label) for i, (_, label) in enumerate(BASE)], "phrase int, base string")
    found = places.join(base, "phrase").groupBy("row").agg(
        F.count("*").alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"), F.collect_set("base").alias("base")
    )
    named = _small(spark, [(t, label) for t, (label, _, _) in enumerate(TEMPLATES)], "template int, label string")
    share = F.round("share", 6)
    # Of the starts of one template in one file the best is listed, so the list stays short.
    best = starts.groupBy("row", "template").agg(F.max_by(F.struct("start", share.alias("share")), F.struct(share, -F.col("start"))).alias("s"))
    spans = best.join(named, "template").groupBy("row").agg(
        F.max("s.share").alias("score"),
        F.collect_set(F.when(F.col("s.share") >= LEAST_SHARE, F.col("label"))).alias("own"),
        F.array_sort(F.collect_list(F.struct("label", F.col("s.start").alias("start"), F.col("s.share").alias("share")))).alias("spans"),
    )
    out = files.drop("hits").join(found, "row", "left").join(spans, "row", "left")
    none = F.array().cast("array<string>")
    listed = lambda c: F.array_join(F.array_sort(c), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        listed(F.coalesce("base", none)).alias("base_labels"),
        listed(F.array_union(F.coalesce("base", none), F.coalesce("own", none))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "spans",
    )
