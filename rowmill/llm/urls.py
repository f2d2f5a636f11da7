"""URL filter: listed rules first, then rules mined from labelled URLs.

A listed rule is a host and a path prefix; it fits the host and all its
subdomains, and the longest fitting rule decides.  All other URLs are judged by
association rules: FP-growth mines the token combinations of labelled URLs,
rules "tokens -> block" are pruned by support, confidence and by shorter rules
that are as sure, and an inverted index from each rule's rarest token finds the
rules a URL may match.

Defined results: a NULL url, or one without ``://``, has empty host and path
and no tokens, so no rule fits and the verdict is the default; repeated rows are
judged separately and alike; an empty table gives no rows; without labelled
URLs nothing is mined; a NULL label is none; of rules that fit alike the surest,
then the best supported, then the last by text is told.  Only the id and url columns are read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.functions.storage import settle

ALLOW, BLOCK = "allow", "block"

# Verdict, host, path prefix.
RULES = [
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
]


@dataclass(frozen=True)
class Mining:
    """Least share of labelled URLs that hold a combination, least share of
    blocked ones among them, and least gain over the overall share of blocked.
    Combinations have any number of tokens; tokens that always occur together
    are mined as one."""

    support: float = 0.002
    confidence: float = 0.5
    lift: float = 1.5
    #: A token that more than this share of the URLs hold tells nothing.
    common: float = 0.95


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct of the longest fitting rule's text and verdict, or NULL."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda x: (len(x[1]) + len(x[2]), x[1] + x[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        told = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, told).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens: host labels, path segments, query keys, extension and
    scheme; digits become ``#``, so numbered pages share their tokens."""
    plain = F.coalesce(url, F.lit(""))
    tag = lambda kind, parts: F.transform(
        F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), F.regexp_replace(x, r"[0-9]+", "#"))
    )
    query = F.regexp_extract(plain, r"(?s)^[^?#]*\?([^#]*)", 1)
    anchor = F.regexp_extract(plain, r"(?s)#(.*)$", 1)
    parts = F.concat(
        tag("host", F.split(host_of(plain), r"[.-]")),
        tag("path", F.split(path_of(plain), "/")),
        tag("key", F.transform(F.split(query, "&"), lambda x: F.split(x, "=", 2)[0])),
        tag("anchor", F.array(anchor)),
        tag("scheme", F.array(F.regexp_extract(plain, r"(?s)^(.*?)://", 1))),
    )
    return F.array_sort(F.array_distinct(F.when(plain.contains("://"), parts).otherwise(F.array().cast("array<string>"))))


def mine(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """``labelled``: url and block (boolean).  Rules: rule (id), items, size,
    confidence, support, key (the rarest item)."""
    spark = labelled.sparkSession
    mark = "="
    told = labelled.filter(F.col("block").isNotNull()).select(
        F.monotonically_increasing_id().alias("id"), tokens(F.col("url")).alias("items"), "block"
    )
    baskets = settle(told)
    totals = baskets.agg(F.count(F.lit(1)).alias("n"), F.count_if("block").alias("blocked")).first()
    empty = spark.createDataFrame([], "rule long, items array<string>, size int, confidence double, support double, key string")
    if not totals["n"] or not totals["blocked"]:
        return empty
    held = baskets.select("id", F.explode("items").alias("item"))
    useful = settle(_together(held, totals["n"], mining))
    # One token stands for all that always occur with it, so shared path segments do not multiply combinations.
    first = useful.filter(F.col("item") == F.col("first")).select("item")
    kept_items = held.join(first, "item").groupBy("id").agg(F.collect_list("item").alias("few"))
    none = F.array().cast("array<string>")
    marked = baskets.select("id", "block").join(kept_items, "id", "left").select(
        F.concat(F.coalesce("few", none), F.when(F.col("block"), F.array(F.lit(mark))).otherwise(none)).alias("items")
    )
    model = FPGrowth(
        itemsCol="items", minSupport=mining.support, minConfidence=mining.confidence,
        numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions")),
    ).fit(marked)
    # Above a blocked share of 1 / lift no rule can reach the lift: half of the way from the share to 1 is enough.
    lift = min(mining.lift, (1 + totals["n"] / totals["blocked"]) / 2)
    gains = (F.col("lift") >= lift) & (F.col("lift") > 1)
    rules = model.associationRules.filter((F.col("consequent")[0] == mark) & gains).select(
        F.array_sort("antecedent").alias("items"), "confidence", "support"
    )
    rules = _spread(_pruned(settle(_keyed(rules, useful))), useful)
    return settle(_keyed(rules, useful).select("rule", "items", "size", "confidence", "support", "key"))


def _together(held: DataFrame, n: int, mining: Mining) -> DataFrame:
    """Per token that can be in a rule: item, share and first, the smallest
    token that stands in exactly the same URLs.  ``held``: id, item."""
    per = held.groupBy("item").agg(
        F.count(F.lit(1)).alias("c"),
        F.bit_xor(F.xxhash64("id")).alias("x1"),
        F.bit_xor(F.xxhash64("id", F.lit("second"))).alias("x2"),
    )
    share = F.col("c") / n
    per = per.filter((share >= mining.support) & (share <= mining.common)).withColumn("share", share)
    firsts = per.groupBy("c", "x1", "x2").agg(F.min("item").alias("first"))
    return per.join(firsts, ["c", "x1", "x2"]).select("item", "share", "first")


def _keyed(rules: DataFrame, useful: DataFrame) -> DataFrame:
    """Adds rule (id), size and key (the rarest item)."""
    named = rules.withColumn("rule", F.xxhash64(F.array_join("items", "\n"))).withColumn("size", F.size("items"))
    rarest = (
        named.select("rule", F.explode("items").alias("item"))
        .join(useful, "item")
        .groupBy("rule")
        .agg(F.min_by("item", F.struct("share", "item")).alias("key"))
    )
    return named.join(rarest, "rule")


def _pruned(rules: DataFrame) -> DataFrame:
    """The rules no part of which is as sure: the index finds their parts."""
    held = rules.select(F.col("rule").alias("long_rule"), F.col("items").alias("long_items"), F.col("size").alias("long_size"), F.col("confidence").alias("long_confidence"), F.explode("items").alias("key"))
    part = (
        held.join(rules, "key")
        .filter((F.col("size") < F.col("long_size")) & (F.col("confidence") >= F.col("long_confidence")))
        .filter(F.size(F.array_except("items", "long_items")) == 0)
        .select(F.col("long_rule").alias("rule"))
    )
    return rules.join(part, "rule", "left_anti")


def _spread(rules: DataFrame, useful: DataFrame) -> DataFrame:
    """A rule for each choice of one token out of those its items stand for."""
    members = useful.select("first", F.col("item").alias("member")).groupBy("first").agg(F.collect_list("member").alias("members"))
    lists = (
        rules.select("rule", "confidence", "support", F.explode("items").alias("first"))
        .join(members, "first")
        .groupBy("rule", "confidence", "support")
        .agg(F.collect_list("members").alias("lists"))
    )
    start = F.array(F.array().cast("array<string>"))
    choices = F.aggregate(
        "lists", start, lambda done, more: F.flatten(F.transform(done, lambda d: F.transform(more, lambda m: F.concat(d, F.array(m)))))
    )
    return lists.select(F.explode(choices).alias("items"), "confidence", "support").withColumn("items", F.array_sort("items"))


def match(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Per distinct ``items`` set that some rule fits: items, confidence and
    mined (the surest rule's tokens, comma-joined)."""
    asked = items.select("items").distinct()
    found = (
        asked.select("items", F.explode("items").alias("key"))
        .join(rules.select("key", F.col("items").alias("needs"), "confidence", "support"), "key")
        .filter(F.size(F.array_except("needs", "items")) == 0)
    )
    best = F.max(F.struct("confidence", "support", F.array_join("needs", ",").alias("text")))
    return found.groupBy("items").agg(best.alias("best")).select(
        "items", F.col("best.confidence").alias("confidence"), F.col("best.text").alias("mined")
    )


def judge(
    pages: DataFrame,
    labelled: DataFrame,
    rules: list[tuple[str, str, str]] | None = None,
    mining: Mining = Mining(),
    default: str = ALLOW,
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """Per row of ``pages``: key, host, path, rule, verdict, mined."""
    listed = RULES if rules is None else rules
    split = pages.select(
        F.col(key).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    ).withColumn("listed", listed_rule(F.col("host"), F.col("path"), listed))
    # Only URLs that no listed rule decides have tokens to match; the others stay out of the join.
    open_ones = split.filter(F.col("listed").isNull()).withColumn("items", tokens(F.col("url")))
    mined = match(open_ones, mine(labelled, mining))
    judged = open_ones.join(mined, "items", "left").select(
        "page_id",
        "host",
        "path",
        F.lit(None).cast("string").alias("rule"),
        F.when(F.col("mined").isNotNull(), F.lit(BLOCK)).otherwise(F.lit(default)).alias("verdict"),
        "mined",
    )
    decided = split.filter(F.col("listed").isNotNull()).select(
        "page_id", "host", "path", "listed.rule", "listed.verdict", F.lit(None).cast("string").alias("mined")
    )
    return judged.unionByName(decided)


def labelled_pages(spark: SparkSession, pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs whose number has a quality label; quality 0 means block."""
    marks = labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("block"))
    return pages.select("page_id", "url").join(marks, "page_id").select("url", "block")
