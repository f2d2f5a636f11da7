"""Line dedup by winnowing over line hashes.

A passage is a window of ``run_lines`` consecutive lines, or the fewest lines
from a line on that hold ``run_words`` words.  Each window's smallest line hash
(the last of equals) is its fingerprint, so equal passages share one wherever
they stand.  Windows whose fingerprint stands in two places or more are
compared by content; a window that stands earlier (by id, text hash and
position) is a repeat, overlapping repeats extend each other to whole runs, and
their lines are deleted.  Every deleted line's text survives at an earlier
place.

Lines are split at ``\\n``; blank ones are no part of passages, go where they
stand inside a repeat and stay elsewhere, unless the text keeps no other line.  Defined results: a NULL text stays NULL, an empty
one empty; rows equal in id and text are one document and get one result; NULL
ids come first; an empty table gives no rows; extra columns pass through, and
no name is added but those returned by ``repeats``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.storage import settle

RUN_LINES = 3
RUN_WORDS = 50


def _lines(text: Column) -> Column:
    """Array of (at, a, b, n) of the lines that are not blank: place, two
    hashes and number of words."""
    split = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    seen = F.transform(
        split,
        lambda line, at: F.struct(
            at.alias("at"),
            F.xxhash64(line).alias("a"),
            F.xxhash64(F.lit(1), line).alias("b"),
            F.when(F.trim(line) == "", 0).otherwise(F.size(F.split(F.trim(line), " "))).alias("n"),
        ),
    )
    return F.filter(seen, lambda x: x["n"] > 0)


def _windows(lines: Column, run_lines: int, run_words: int) -> Column:
    """Array of (first, last, a, b, print): both passage kinds from each line on."""

    def window(part: Column) -> Column:
        ends = F.sort_array(F.transform(part, lambda x, i: F.struct(x["a"].alias("a"), x["b"].alias("b"), (-i).alias("i"))))
        return F.struct(
            part[0]["at"].alias("first"),
            F.element_at(part, -1)["at"].alias("last"),
            F.xxhash64(F.transform(part, lambda x: x["a"])).alias("a"),
            F.xxhash64(F.transform(part, lambda x: x["b"])).alias("b"),
            ends[0]["a"].alias("print"),
        )

    def words(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda acc, x: acc + x["n"])

    def starting(_: Column, i: Column) -> Column:
        part = F.slice(lines, i + 1, run_lines)
        out = [F.when(F.size(part) == run_lines, window(part))]
        for n in range(1, run_lines):
            shorter, before = F.slice(lines, i + 1, n), F.slice(lines, i + 1, n - 1)
            fits = (F.size(shorter) == n) & (words(shorter) >= run_words) & (words(before) < run_words)
            out.append(F.when(fits, window(shorter)))
        return F.array(*out)

    return F.filter(F.flatten(F.transform(lines, starting)), lambda w: w.isNotNull())


def repeats(
    docs: DataFrame, run_lines: int = RUN_LINES, run_words: int = RUN_WORDS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Documents with repeated lines: doc_id, text_hash and ``cut``, the sorted
    distinct places (from 0) of the lines to delete."""
    read = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), _lines(F.col(text)).alias("lines"))
    # Written, so that the line arrays are read, not made anew, inside the windows.
    lined = settle(read)
    windows = settle(
        lined.select("doc_id", "text_hash", F.explode(_windows(F.col("lines"), run_lines, run_words)).alias("w")).select(
            "doc_id", "text_hash", "w.*"
        )
    )
    prints = windows.select("print", "doc_id", "text_hash", "first").distinct().groupBy("print").count()
    shared = settle(prints.filter(F.col("count") > 1).select("print"))
    met = windows.join(shared, "print")
    place = F.struct("doc_id", "text_hash", "first")
    origin = settle(
        met.groupBy("a", "b")
        .agg(F.min(place).alias("origin"), F.max(place).alias("latest"))
        .filter(~F.col("origin").eqNullSafe(F.col("latest")))
        .select("a", "b", "origin")
    )
    later = windows.join(origin, ["a", "b"]).filter(~place.eqNullSafe(F.col("origin")))
    return later.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("first", "last"))))).alias("cut")
    )


def dedup_lines(
    docs: DataFrame,
    run_lines: int = RUN_LINES,
    run_words: int = RUN_WORDS,
    key: str = "doc_id",
    text: str = "text",
    cut: str | None = None,
) -> DataFrame:
    """``docs`` with repeated lines deleted from ``text``; ``cut`` names a
    column for the deleted places (NULL if none).  A text that keeps no line
    but blank ones becomes empty."""
    found = repeats(docs, run_lines, run_words, key, text).select(
        F.col("doc_id").alias("_rm_id"), F.col("text_hash").alias("_rm_hash"), F.col("cut").alias("_rm_cut")
    )
    joined = docs.join(found, F.col(key).eqNullSafe(F.col("_rm_id")) & (F.xxhash64(F.col(text)) == F.col("_rm_hash")), "left")
    split = F.split(F.col(text), "\n", -1)
    left = F.filter(split, lambda line, at: ~F.array_contains(F.col("_rm_cut"), at))
    bare = F.forall(left, lambda line: F.trim(line) == "")
    cleaned = F.when(F.col("_rm_cut").isNull(), F.col(text)).when(bare, "").otherwise(F.array_join(left, "\n"))
    out = joined.withColumn(text, cleaned)
    if cut:
        out = out.withColumn(cut, F.col("_rm_cut"))
    return out.drop("_rm_id", "_rm_hash", "_rm_cut")
