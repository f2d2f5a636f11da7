"""Benchmark decontamination by template canonicalisation.

Words become tokens: a number, a name (a capital and small letters, after a lower-case letter,
digit or comma and a blank) or a unit (after a number) is replaced by a typed
placeholder, everything else by its lower case.  Windows of ``WINDOW`` tokens
are hash-joined with those of the benchmark items, matches are gathered by item
and offset, neighbouring offsets merged, and an item counts as leaked where
``COVERAGE`` of its tokens are covered.  Then the slots are compared, along the
offset of the windows that hold them: from ``AGREE`` of them on, the values that
stand for one item value must be one value, so a re-parameterised item is caught
and a chance likeness of templates is not.  Where windows of the very same words
reach ``COVERAGE``, slots have no say.

Defined results: a NULL or empty text matches nothing; an item of fewer than
``WINDOW`` tokens is matched word for word, all of it; repeated rows are judged separately; an item
met several times in a text is told once, at its best place; empty tables give
no rows; only the id and text columns are read.  U+0001 to U+0003 mark slots: in
a text they count as such marks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowmill.functions.storage import settle

WINDOW = 8
COVERAGE = 0.5
#: Share of the slots met whose item value stands for one value.
AGREE = 0.9
#: Inserted or deleted tokens up to this number keep two offsets together.
MERGE_GAP = 3
#: Up to this many distinct item windows are tested where the text is read.
LISTED = 200_000

NUMBER, NAME, UNIT = "\u0001", "\u0002", "\u0003"
UNITS = (
    "km cm mm m kg g mg lb lbs oz l ml mi ft in yd s sec secs seconds second min mins minutes minute h hr hrs hours hour "
    "days day weeks week months month years year percent dollars dollar cents euros euro pounds pound miles mile meters meter "
    "metres metre liters liter litres litre grams gram inches inch feet foot degrees degree mph kmh usd eur gbp"
).split()


def slotted_words(text: Column) -> Column:
    """Words in lower case; slot values keep a mark of their type in front."""
    out = F.coalesce(text, F.lit(""))
    out = F.regexp_replace(out, rf"(?i)(?<=\p{{Nd}} ?)({'|'.join(UNITS)})(?![\p{{L}}\p{{Nd}}])", f" {UNIT}$1")
    out = F.regexp_replace(out, r"(?<=[\p{Ll}\p{Nd},] )(\p{Lu}\p{Ll}\p{L}*)", f"{NAME}$1")
    out = F.regexp_replace(out, r"(\p{Nd}+)", f" {NUMBER}$1 ")
    return F.filter(F.split(F.lower(out), "[^\\p{L}\\p{M}\\p{Nd}\u0001-\u0003]+"), lambda w: w != "")


def _mark(word: Column) -> Column:
    return F.when(word.startswith(NUMBER), NUMBER).when(word.startswith(NAME), NAME).when(word.startswith(UNIT), UNIT)


def _with_windows(df: DataFrame, size: int, into: str) -> DataFrame:
    """Adds an array with one hash per window of ``size`` tokens of ``words``.

    Hashes of 1, 2, 4 ... tokens are made in columns of their own, each used
    twice, so that Catalyst keeps them apart and none is computed again.
    """
    df = df.withColumn("_p1", F.transform("words", lambda w: F.xxhash64(F.coalesce(_mark(w), w))))
    out, held, width = None, 0, 1
    while width <= size:
        if size & width:
            out, held = (f"_p{width}", width) if out is None else (f"_o{width}", held + width)
            if out[1] == "o":
                df = df.withColumn(out, _joined(F.col(before), F.col(f"_p{width}"), held - width))
            before = out
        width *= 2
        if width <= size:
            df = df.withColumn(f"_p{width}", _joined(F.col(f"_p{width // 2}"), F.col(f"_p{width // 2}"), width // 2))
    whole = F.slice(out, F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(0)))
    df = df.withColumn(into, F.when(F.size("words") >= size, whole).otherwise(F.array().cast("array<bigint>")))
    return df.drop(*[c for c in df.columns if re.fullmatch("_[po][0-9]+", c)])


def _joined(a: Column, b: Column, shift: int) -> Column:
    """Hash of a[i] and b[i + shift]; entries past the end are not used."""
    return F.zip_with(a, F.slice(b, shift + 1, F.greatest(F.size(b), F.lit(1))), lambda x, y: F.xxhash64(x, y))


def _typed(words: Column) -> Column:
    """Array of (pos, word) of the slots."""
    placed = F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    return F.filter(placed, lambda x: _mark(x["word"]).isNotNull())


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """gram, item_id, ipos, size per window of every item."""
    worded = items.select(F.col(key).alias("item_id"), slotted_words(F.col(text)).alias("words"))
    made = _with_windows(worded, WINDOW, "grams").select(
        "item_id", F.size("words").alias("size"), F.posexplode("grams").alias("ipos", "gram")
    )
    return made.select("gram", "item_id", "ipos", "size")


def _plain(word: Column) -> Column:
    """A word without the mark of its type, which depends on the words before it."""
    return F.translate(word, NUMBER + NAME + UNIT, "")


def short_items(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """gram, item_id, size, plain (the words) and n_slots per item too short for a window."""
    words = slotted_words(F.col(text))
    worded = items.select(F.col(key).alias("item_id"), words.alias("words")).filter(F.size("words").between(1, WINDOW - 1))
    plain = worded.select(
        "item_id", F.size("words").alias("size"), F.transform("words", _plain).alias("plain"), F.size(_typed(F.col("words"))).alias("n_slots")
    )
    return plain.withColumn("gram", F.xxhash64("plain"))


def _with_short_hits(df: DataFrame, known: dict[int, list[int]]) -> DataFrame:
    """Adds ``short``: gram, size, pos and plain words of the places that may be a
    short item; ``known`` has the items' hashes by length."""
    kind = "array<struct<gram:bigint,size:int,pos:int,plain:array<string>>>"
    if not known:
        return df.withColumn("short", F.array().cast(kind))
    df = df.withColumn("_plain", F.transform("words", _plain))
    parts = []
    for n, grams in sorted(known.items()):
        # Each lambda is called at once, within its turn of the loop.
        places = F.transform(
            F.slice("_plain", F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(0))),
            lambda w, i: F.struct(F.slice("_plain", i + 1, F.lit(n)).alias("plain"), i.alias("pos")),
        )
        hashed = F.transform(
            places, lambda x: F.struct(F.xxhash64(x["plain"]).alias("gram"), F.lit(n).alias("size"), x["pos"].alias("pos"), x["plain"].alias("plain"))
        )
        parts.append((F.filter(hashed, lambda x: x["gram"].isin(grams)) if len(grams) <= LISTED else hashed).cast(kind))
    return df.withColumn("short", F.concat(*parts)).drop("_plain")


def _short_matches(found: DataFrame, shorts: DataFrame) -> DataFrame:
    """row, item_id, coverage, offset, n_slots and exact of the short items, all words compared."""
    hits = found.select("row", F.explode("short").alias("h")).select("row", "h.*")
    return hits.join(shorts, ["gram", "size", "plain"]).groupBy("row", "item_id").agg(
        F.lit(1.0).alias("coverage"), F.min("pos").alias("offset"), F.max("n_slots").cast("long").alias("n_slots"), F.lit(True).alias("exact")
    )


def leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document and item found in it: doc_id, row (internal), item_id,
    coverage, first_word, n_slots and exact (all slots have the item's values)."""
    grams = settle(item_windows(items, item_key, item_text))
    distinct = grams.select("gram").distinct()
    listed = [r["gram"] for r in distinct.limit(LISTED + 1).collect()]
    worded = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).select(
        "doc_id", slotted_words(F.col("text")).alias("words")
    )
    placed = F.transform("grams", lambda g, i: F.struct(g.alias("gram"), i.alias("pos")))
    # With few items the semi join is done in place; with many all windows go to the join.
    hits = F.filter(placed, lambda x: x["gram"].isin(listed)) if len(listed) <= LISTED else placed
    # Written once, so row numbers hold even if a task runs again; filtered after
    # that, since a filter here would be pushed down and make all of it twice.
    windowed = _with_windows(worded, WINDOW, "grams").select("doc_id", "words", hits.alias("hits"), _typed(F.col("words")).alias("slots"))
    shorts, known = settle(short_items(items, item_key, item_text)), {}
    lengths = [r["size"] for r in shorts.select("size").distinct().collect()]
    for n in lengths:
        known[n] = [r["gram"] for r in shorts.filter(F.col("size") == n).select("gram").distinct().limit(LISTED + 1).collect()]
    found = settle(
        _with_short_hits(windowed, known).drop("words").withColumn("row", F.monotonically_increasing_id())
    ).filter((F.size("hits") > 0) | (F.size("short") > 0))
    matched = (
        found.select("row", F.explode("hits").alias("h"))
        .select("row", "h.*")
        .join(grams, "gram")
        .groupBy("row", "item_id", "size", (F.col("pos") - F.col("ipos")).alias("offset"))
        .agg(F.collect_set("ipos").alias("ats"))
    )
    by = W.partitionBy("row", "item_id").orderBy("offset")
    apart = F.col("offset") - F.lag("offset", 1, -(10**9)).over(by) > MERGE_GAP
    grouped = matched.withColumn("group", F.sum(apart.cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    covered = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("ats")), lambda a: F.sequence(a, a + WINDOW - 1))))
    places = grouped.groupBy("row", "item_id", "size", "group").agg(
        (F.size(covered) / F.col("size")).alias("coverage"),
        F.max_by("offset", F.struct(F.size("ats"), -F.col("offset"))).alias("best"),
        F.collect_list(F.struct("offset", "ats")).alias("runs"),
    )
    near = settle(places.filter(F.col("coverage") >= COVERAGE))
    item_slots = items.select(
        F.col(item_key).alias("item_id"), F.explode(_typed(slotted_words(F.col(item_text)))).alias("i")
    ).select("item_id", F.col("i.pos").alias("ipos"), F.col("i.word").alias("item"))
    doc_slots = found.join(near.select("row").distinct(), "row").select("row", F.explode("slots").alias("d"))
    doc_slots = doc_slots.select("row", F.col("d.pos").alias("pos"), F.col("d.word").alias("doc"))
    place, run = ["row", "item_id", "group"], ["row", "item_id", "group", "offset"]
    runs = near.select(*place, "size", "best", F.explode("runs").alias("r")).select(*place, "size", "best", "r.*")
    # Slots of one type that stand at the same place of a window, along its own offset; beyond windows along the best one.
    held = F.exists("ats", lambda a: F.col("ipos").between(a, a + WINDOW - 1))
    pairs = (
        runs.join(item_slots, "item_id")
        .withColumn("held", held)
        .filter(F.col("held") | (F.col("offset") == F.col("best")))
        .withColumn("pos", F.col("ipos") + F.col("offset"))
        .join(doc_slots, ["row", "pos"])
        .filter(F.substring("doc", 1, 1) == F.substring("item", 1, 1))
    )
    edits = pairs.filter(F.col("held") & (F.col("item") != F.col("doc"))).groupBy(*run).agg(F.collect_set("ipos").alias("edits"))
    literal = F.filter("ats", lambda a: ~F.exists(F.coalesce("edits", F.array().cast("array<int>")), lambda e: e.between(a, a + WINDOW - 1)))
    words = settle(runs.join(edits, run, "left").withColumn("literal", literal).select(*run, "size", F.size("ats").alias("n"), "literal"))
    same = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("literal")), lambda a: F.sequence(a, a + WINDOW - 1))))
    verbatim = words.groupBy(*place, "size").agg(same.alias("same")).select(*place, (F.size("same") / F.col("size")).alias("verbatim"))
    # Where windows of several offsets hold a slot, the offset with most literal windows, then most windows, tells.
    weight = F.struct(F.col("held"), F.size("literal"), F.col("n"), -F.col("offset"))
    chosen = (
        pairs.join(words.select(*run, "n", "literal"), run)
        .groupBy(*place, "ipos")
        .agg(F.max_by(F.struct("item", "doc", "held"), weight).alias("p"))
        .select(*place, "p.*")
    )
    values = chosen.groupBy(*place, "item", "doc").agg(F.count(F.lit(1)).alias("n"), F.count_if("held").alias("held"))
    tops = values.groupBy(*place, "item").agg(
        F.max("held").alias("top"), F.sum("held").alias("held"), F.sum("n").alias("n"), F.bool_and(F.col("item") == F.col("doc")).alias("exact")
    )
    slots = tops.groupBy(*place).agg(
        (F.sum("top") / F.nullif(F.sum("held"), F.lit(0))).alias("agree"), F.sum("n").alias("n_slots"), F.bool_and("exact").alias("exact")
    )
    told = (
        near.drop("runs")
        .join(verbatim, place)
        .join(slots, place, "left")
        .filter((F.col("verbatim") >= COVERAGE) | (F.coalesce("agree", F.lit(1.0)) >= AGREE))
        .select(
            "row", "item_id", "coverage", F.col("best").alias("offset"),
            F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), F.coalesce("exact", F.lit(True)).alias("exact"),
        )
    )
    if lengths:
        told = told.unionByName(_short_matches(found, shorts))
    best = W.partitionBy("row", "item_id").orderBy(F.desc("coverage"), "offset")
    return (
        told.withColumn("_place", F.row_number().over(best))
        .filter(F.col("_place") == 1)
        .join(found.select("row", "doc_id"), "row")
        .select("doc_id", "row", "item_id", "coverage", F.greatest("offset", F.lit(0)).cast("long").alias("first_word"), "n_slots", "exact")
    )
