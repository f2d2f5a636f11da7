"""Mixing sources to target weights by weighted fair queueing.

Every document queues once per epoch, shuffled within its source and epoch by a
hash.  Its virtual finish time is the words its source has queued up to its end,
divided by the source's target.  All sources are merged by one global range sort
on that time, and the queue is truncated where the budget is spent; the packet
across that place is cut.

At finish time 1 each source has queued just its target, and the targets add up
to the budget.  A document that stands across time 1 queues as packets of
``QUANTUM`` words, so one long document cannot push a source off its target.

Words are runs without ASCII white space.  Sources are counted, ranked and
levelled as Spark tables of any length; only level sums reach the driver.

Defined results: a NULL text has no words; a NULL source is a source of its own,
ranked last; documents without words queue with nothing to take; a source
without words has target 0; rows are mixed separately, repeated or not; an empty
table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.lookup import attach
from rowmill.functions.ordering import global_rank, running_totals
from rowmill.functions.storage import settle

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No document is taken more often than this.
EPOCHS = 3
#: Words of a packet of a document across the truncation.
QUANTUM = 64
SEED = 1

_WORD = "[^\\x20\\x09-\\x0D]+"
_MONEY = "decimal(18,6)"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def sized_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, _row)``, written; the texts are read only here."""
    slim = docs.select("doc_id", "source", words().alias("size"))
    return settle(slim.withColumn("_row", F.monotonically_increasing_id()))


def source_table(sized: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``(source, n, source_size, no, weight)`` per source.

    ``weights``: ``(source, weight)``, sources not in it weigh 0; without it the
    sources weigh ``WEIGHTS`` in turn.
    """
    counted = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    ranked = global_rank(settle(counted), [F.col("source").asc_nulls_last()], "no")
    if weights is None:
        turn = F.array(*[F.lit(w) for w in WEIGHTS])
        given = turn[F.pmod(F.col("no") - 1, F.lit(len(WEIGHTS))).cast("int")]
        return settle(ranked.withColumn("weight", given.cast(_MONEY)))
    asked = weights.groupBy(F.col("source").alias("_named")).agg(F.max("weight").alias("weight"))
    joined = ranked.join(asked, F.col("source").eqNullSafe(F.col("_named")), "left").drop("_named")
    return settle(joined.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0)).cast(_MONEY)))


def with_targets(sources: DataFrame, share: float = 1.0, epochs: int = EPOCHS) -> tuple[DataFrame, int]:
    """``sources`` with ``target``, and the budget.

    Budget by weight, each source at most ``epochs`` times its size; what that
    leaves over is shared anew by weight until no source is above its limit.
    """
    limit = F.col("source_size") * epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget, level, full = int(total * share), 0.0, -1
    while True:
        above = F.col("weight").cast("double") * F.lit(level) > limit.cast("double")
        row = sources.agg(
            F.count_if(above).alias("full"),
            F.sum(F.when(above, limit)).alias("spent"),
            F.sum(F.when(~above, F.col("weight"))).alias("weight"),
        ).first()
        if row["full"] <= full or not row["weight"]:
            break
        full, level = row["full"], (budget - int(row["spent"] or 0)) / float(row["weight"])
    # Where every weighted source is full, each takes its limit.
    if full >= 0 and not row["weight"]:
        level = float("inf")
    wanted = F.when(F.col("weight") > 0, F.col("weight").cast("double") * F.lit(level)).otherwise(F.lit(0.0))
    return sources.withColumn("target", F.least(limit.cast("double"), wanted)), budget


def queue(
    docs: DataFrame,
    weights: DataFrame | None = None,
    share: float = 1.0,
    epochs: int = EPOCHS,
    quantum: int = QUANTUM,
    seed: int = SEED,
) -> DataFrame:
    """The whole queue, one row per packet: ``doc_id, source, size, source_size,
    target, epoch, first_word, n_words, finish, taken, _row``.

    ``taken`` is how many of the packet's words the mix takes, from its first on;
    all in front of the truncation, none behind it.
    """
    sized = sized_documents(docs)
    sources, budget = with_targets(source_table(sized, weights), share, epochs)
    rows = attach(sized, settle(sources.withColumnRenamed("source", "key")), "source", ["source_size", "no", "target"])
    turns = F.greatest(F.lit(1), F.least(F.lit(epochs), F.ceil(F.try_divide("target", "source_size")).cast("int")))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.coalesce(turns, F.lit(1)) - 1)))
    rows = rows.withColumn("_key", F.md5(F.concat_ws(":", F.lit(seed), "epoch", "doc_id")))
    rows = running_totals(rows, [F.col(c) for c in ("_key", "doc_id", "_row")], {"_end": F.col("size")}, ["no", "epoch"])
    rows = rows.withColumn("_end", F.col("_end") + F.col("epoch") * F.col("source_size"))
    across = (F.col("_end") - F.col("size") < F.col("target")) & (F.col("_end") > F.col("target"))
    firsts = F.when(across, F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(quantum).cast("long")))
    rows = rows.withColumn("_firsts", F.coalesce(firsts, F.array(F.lit(0).cast("long"))))
    rows = rows.withColumn("_across", F.size("_firsts") > 1).withColumn("first_word", F.explode("_firsts"))
    left = F.col("size") - F.col("first_word")
    rows = rows.withColumn("n_words", F.when(F.col("_across"), F.least(left, F.lit(quantum))).otherwise(left))
    reached = F.col("_end") - left + F.col("n_words")
    # A source with target 0 queues behind all others.
    without = F.when(F.col("size") > 0, float("inf")).otherwise(F.lit(0.0))
    rows = rows.withColumn("finish", F.coalesce(F.try_divide(reached, F.col("target")), without))
    order = [F.col(c) for c in ("finish", "no", "epoch", "_key", "doc_id", "_row", "first_word")]
    merged = running_totals(rows.drop("_firsts", "_across", "_end"), order, {"_spent": F.col("n_words")})
    room = F.lit(budget).cast("long") - (F.col("_spent") - F.col("n_words"))
    taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("n_words"), room))
    return merged.withColumn("taken", taken).drop("no", "_key", "_spent")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document what the mix takes of it in all epochs: ``doc_id, source,
    size, source_size, target, taken``; ``options`` as of ``queue``."""
    same = [F.any_value(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")]
    return queue(docs, **options).groupBy("_row").agg(*same, F.sum("taken").alias("taken")).drop("_row")
