"""License scan by diagonal voting.

Word k-grams of a document that also stand in a license template vote for the
diagonal (document position minus template position).  Neighbouring diagonals
are merged, so that a template survives inserted or deleted words, and the
merged span is verified by its coverage and length.  One that is too long, as
where a notice stands twice in close order, is searched for the spans inside it
that are not; of overlapping ones the better is told.  Gram hashes only propose:
the join compares the words themselves.

Defined results: a NULL or empty text has no words, no places and score 0;
repeated rows are judged separately; an empty table gives no rows; only the id
and text columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowmill.functions.storage import settle

GRAM = 2
#: Inserted or deleted words up to this number keep two diagonals together.
MERGE_GAP = 3
#: A template of over SHORT words counts from this share of its grams on.
COVERAGE = 0.6
SHORT = 4
#: A verified span is at most this many times as long as its template.
STRETCH = 1.5

# Phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public license notices; a label may have several.
NOTICES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files to deal in the software without restriction including without limitation the rights to use "
        "copy modify merge publish distribute sublicense and or sell copies of the software",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation",
    ],
    "apache": [
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www "
        "apache org licenses license 2 0",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "mozilla public license",
    ],
    "lgpl": ["gnu lesser general public license"],
    "cc-by": ["creative commons attribution"],
    "cc-by-nc": ["cc by nc", "creative commons attribution noncommercial"],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike"],
    "cc0": ["creative commons zero", "cc0 1 0 universal"],
    "all-rights-reserved": ["all rights reserved"],
}


@dataclass(frozen=True)
class Template:
    """``base`` templates count only where all their words stand in a row."""

    id: int
    label: str
    words: tuple[str, ...]
    base: bool


def templates(base: dict[str, str] = BASE_PHRASES, notices: dict[str, list[str]] = NOTICES) -> list[Template]:
    listed = [(label, text, True) for text, label in base.items()]
    listed += [(label, text, False) for label, texts in notices.items() for text in texts]
    out = [Template(i, label, tuple(text.split()), whole) for i, (label, text, whole) in enumerate(listed)]
    if any(len(t.words) < GRAM for t in out):
        raise ValueError(f"a template needs at least {GRAM} words")
    return out


def positions(spark: SparkSession, made: list[Template]) -> DataFrame:
    """One row per gram of every template; as large as the given templates."""
    rows = [
        (t.id, t.label, t.base, len(t.words), at, t.words[at], t.words[at + 1])
        for t in made
        for at in range(len(t.words) - GRAM + 1)
    ]
    kinds = "template int, label string, base boolean, size int, at int, one string, two string"
    return spark.createDataFrame(rows, kinds).withColumn("gram", F.xxhash64("one", "two"))


def scan_words(text: Column) -> Column:
    """Words of digits, letters and all beyond ASCII, A-Z lower-cased."""
    # The only two other characters whose lower case holds an ASCII letter.
    odd = text.contains("K") | text.contains("İ")
    lowered = F.lower(F.when(odd, F.translate(text, "Kİ", "��")).otherwise(text))
    pieces = F.split(F.coalesce(lowered, F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(pieces, lambda w: w != "")


def _inner_spans(groups: DataFrame, longest: int) -> DataFrame:
    """row, label, base, coverage, start, end of the spans of allowed length within
    ``groups``; ``longest`` is the longest of all.  A span goes where a better one
    overlaps it: more coverage, then fewer words, then the first.  Work is linear
    in the hits."""
    hits = (
        groups.select("row", "template", "group", "label", "base", "size", "least", F.explode("votes").alias("v"))
        .withColumn("at", F.explode("v.ats"))
        .withColumn("start", F.col("at") + F.col("v.diagonal"))
        .drop("v")
    )
    by = W.partitionBy("row", "template", "group").orderBy("start")
    ahead = F.collect_list(F.struct(F.col("start").alias("pos"), "at")).over(by.rangeBetween(0, longest - GRAM))
    # Ended where the last part of the template that the span adds is met.
    held = F.aggregate(
        F.filter("ahead", lambda h: h["pos"] + GRAM - F.col("start") <= STRETCH * F.col("size")),
        F.struct(F.array().cast("array<int>").alias("ats"), F.lit(0).alias("end")),
        lambda held, h: F.when(F.array_contains(held["ats"], h["at"]), held).otherwise(
            F.struct(F.array_append(held["ats"], h["at"]).alias("ats"), (h["pos"] + GRAM).alias("end"))
        ),
    )
    spans = (
        hits.withColumn("ahead", ahead)
        .withColumn("held", held)
        .withColumn("coverage", F.size("held.ats") / (F.col("size") - GRAM + 1))
        .withColumn("end", F.col("held.end"))
        .filter(F.col("coverage") >= F.col("least"))
        .select("row", "template", "group", "label", "base", "coverage", "start", "end")
        .distinct()
        .withColumn("rank", F.struct(-F.col("coverage"), F.col("end") - F.col("start"), "start", "end"))
    )
    near = F.collect_list("rank").over(by.rangeBetween(-longest, longest))
    beaten = F.exists(
        "near", lambda o: (o["start"] < F.col("end")) & (F.col("start") < o["end"]) & (o < F.col("rank"))
    )
    return spans.withColumn("near", near).filter(~beaten).select("row", "label", "base", "coverage", "start", "end")


def scan(docs: DataFrame, made: list[Template] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_words, n_base, first_word, last_word,
    base_labels, labels, score and ``spans`` (array of label, start, end,
    coverage; word positions, end excluded)."""
    spark = docs.sparkSession
    made = templates() if made is None else made
    grams = positions(spark, made)
    # The semi join with the templates' grams, done where the words are made.
    known = [r["gram"] for r in grams.select("gram").distinct().collect()]
    worded = docs.select(F.col(key).alias("doc_id"), scan_words(F.col(text)).alias("words"))
    pairs = F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.struct(a.alias("one"), b.alias("two")))
    hits = F.filter(
        F.transform(pairs, lambda g, i: F.struct(F.xxhash64(g["one"], g["two"]).alias("gram"), i.alias("pos"), g["one"].alias("one"), g["two"].alias("two"))),
        lambda g: g["gram"].isin(known),
    )
    # Written once, so row numbers hold even if a task runs again.
    found = settle(
        worded.select("doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits")).withColumn(
            "row", F.monotonically_increasing_id()
        )
    )
    votes = (
        found.select("row", F.explode("hits").alias("h"))
        .select("row", "h.*")
        .join(F.broadcast(grams), ["gram", "one", "two"])
        .groupBy("row", "template", "label", "base", "size", (F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(
            F.collect_set("at").alias("ats"),
            F.min("pos").alias("start"),
            (F.max("pos") + GRAM).alias("end"),
        )
    )
    by = W.partitionBy("row", "template").orderBy("diagonal")
    # Diagonals of a base phrase stay apart: each is one exact place.
    apart = F.col("base") | (F.col("diagonal") - F.lag("diagonal", 1, -(10**9)).over(by) > MERGE_GAP)
    groups = votes.withColumn("group", F.sum(apart.cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    merged = (
        groups.groupBy("row", "template", "label", "base", "size", "group")
        .agg(
            (F.size(F.array_distinct(F.flatten(F.collect_list("ats")))) / (F.col("size") - GRAM + 1)).alias("coverage"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.collect_list(F.struct("diagonal", "ats")).alias("votes"),
        )
    )
    least = F.when(F.col("base") | (F.col("size") <= SHORT), F.lit(1.0)).otherwise(F.lit(COVERAGE))
    fits = F.col("base") | (F.col("end") - F.col("start") <= STRETCH * F.col("size"))
    judged = merged.withColumn("least", least).filter(F.col("coverage") >= F.col("least")).withColumn("fits", fits)
    # Only what is covered but too long is searched; the rest is verified as it stands.
    longest = int(STRETCH * max((len(t.words) for t in made), default=GRAM))
    searched = _inner_spans(judged.filter(~F.col("fits")), longest)
    verified = judged.filter("fits").select("row", "label", "base", "coverage", "start", "end").unionByName(searched)
    told = verified.groupBy("row").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
        F.array_sort(F.collect_list(F.struct("start", "end", "label", "coverage"))).alias("spans"),
    )
    return found.select("row", "doc_id", "n_words").join(told, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "spans",
    )
