"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of ``docs``, extra ones included.

Defined results: an id names a document, so where a stage drops an id, all rows
with it go (NULL ids are one such id); near-dedup drops an id only if none of
its rows is kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.functions.storage import settle
from rowmill.llm import decontaminate, lines, neardup, packing, quality
from rowmill.llm.queries_packing import tokenizer


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for the ids in ``ids`` (one column, doc_id)."""
    gone = ids.select(F.col("doc_id").alias("_rm_id")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_rm_id")), "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the compression classifier does not reject; all where no model can be fitted."""
    model = quality.learn(spark, sf_dir)
    if model is None:
        return docs
    scored = quality.score(docs, model, into="_rm_score")
    return scored.filter(F.col("_rm_score") >= quality.THRESHOLD).drop("_rm_score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines.  A document that was nothing but
    repeats goes; ``n_chars`` follows the text."""
    done = lines.dedup_lines(docs, cut="_rm_cut_lines")
    changed = F.col("_rm_cut_lines").isNotNull()
    done = done.filter(~(changed & (F.col("text") == "")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.drop("_rm_cut_lines")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8)."""
    judged = neardup.near_duplicates(docs, size=5, percent=80)
    gone = judged.groupBy("doc_id").agg(F.bool_or("kept").alias("stays")).filter(~F.col("stays"))
    return _without(docs, settle(gone.select("doc_id")))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, settle(found.select("doc_id")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack_documents(docs, tokenizer())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Compression and tokenising cannot be said in SQL; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
