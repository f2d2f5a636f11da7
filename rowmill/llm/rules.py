"""Quality rules: fixed base rules, then robust multivariate outliers.

The base rules count over whole texts.  The method transforms those counts to a
vector and, for each language and source, estimates its centre and scatter by
the minimum covariance determinant: from medians and median deviations on,
concentration steps keep the ``SUPPORT`` of rows that lie nearest and estimate
anew.  Every step is an aggregate over all rows; a group never meets in one
task.  A text whose squared Mahalanobis distance passes ``CUTOFF`` is rejected.

Groups below ``MIN_GROUP`` rows are pooled by language, then all together.

Defined results: a NULL or empty text has zeros everywhere and fails the base
rules; a NULL language or source is a group value of its own; rows that fail
the base rules take no part in the estimates; rows are judged separately,
repeated or not; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.storage import settle
from rowmill.llm.shingles import WordHashes, windows

# Fixed values of the base rules.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

SUPPORT = 0.75
STEPS = 4
MIN_GROUP = 50
#: Chi-square quantile of 6 dimensions at 1 - 1e-6.
CUTOFF = 38.3
#: Makes the scatter of the nearest 3/4 that of the whole, for 6 dimensions.
CONSISTENCY = 1.36
#: Least standard deviation of each dimension: a group whose texts are all
#: alike must not reject the first that differs a little.
FLOOR = (0.5, 0.15, 0.15, 0.12, 0.08, 0.08)
DIM = len(FLOOR)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


def repeat_words(hashes: np.ndarray, size: int = WINDOW) -> int:
    """Words inside a window of ``size`` words that stands twice or more."""
    if len(hashes) < size:
        return 0
    _, which, count = np.unique(windows(hashes, size), return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[which] > 1)
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _row(data: bytes | None, hashes: WordHashes) -> tuple:
    data = data or b""
    words = data.split()
    joined = np.frombuffer(b"".join(words), np.uint8)
    lines = [x for x in data.split(b"\n") if x.strip()]
    hashed = hashes.of(words)
    letters = len(data) - len(data.translate(None, _LETTERS))
    upper = len(data) - len(data.translate(None, _LETTERS[:26]))
    return (
        len(words),
        int(((joined & 0xC0) != 0x80).sum()),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(hashed),
        len(lines),
        upper,
        letters,
        int((hashed[1:] == hashed[:-1]).sum()),
    )


def counts(docs: DataFrame) -> DataFrame:
    """``docs``: doc_id, lang, source, text.  The base counts per row, with
    n_lines, n_upper and n_letters (A-Z, a-z) and n_echo (words that follow
    themselves)."""
    names = [*COUNTS, "n_lines", "n_upper", "n_letters", "n_echo"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = [_row(x, hashes) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            made = np.array(rows, np.int64).reshape(-1, len(names))
            kept = ["doc_id", "lang", "source"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(pa.array(np.ascontiguousarray(made[:, i])) for i in range(len(names)))], kept + names
            )

    return docs.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names))


def _vector() -> list[Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return [
        F.log1p(1000 * share("n_symbols", "word_chars")),
        F.sqrt(share("n_dup_lines", "n_lines")),
        F.sqrt(share("n_repeat_words", "n_words")),
        # Short texts lean to five characters a word.
        F.log((F.col("word_chars") + 250) / (F.col("n_words") + 50)),
        F.sqrt(share("n_upper", "n_letters")),
        F.sqrt(share("n_echo", "n_words")),
    ]


def _grouped(rows: DataFrame) -> DataFrame:
    """Adds ``g``: language and source, or a pool of the small ones."""
    own = F.to_json(F.struct(F.lit("own"), "lang", "source"))
    pool = F.to_json(F.struct(F.lit("lang"), "lang"))
    fit = rows.filter(~F.col("base_failed"))
    large = settle(fit.groupBy(own.alias("g0")).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= MIN_GROUP).select("g0"))
    first = rows.withColumn("g0", own).join(large.withColumn("l0", F.lit(True)), "g0", "left")
    small = first.filter(F.col("l0").isNull() & ~F.col("base_failed"))
    pools = settle(small.groupBy(pool.alias("g1")).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= MIN_GROUP).select("g1"))
    second = first.withColumn("g1", pool).join(pools.withColumn("l1", F.lit(True)), "g1", "left")
    g = F.when(F.col("l0"), F.col("g0")).when(F.col("l1"), F.col("g1")).otherwise(F.lit("all"))
    return second.withColumn("g", g).drop("g0", "l0", "g1", "l1")


def _distance() -> Column:
    """Squared Mahalanobis distance to ``m`` with the inverse scatter ``w``."""
    off = [F.col(f"x{i}") - F.col("m")[i] for i in range(DIM)]
    out = F.lit(0.0)
    for i in range(DIM):
        for j in range(i, DIM):
            term = F.col("w")[i * DIM + j] * off[i] * off[j]
            out = out + (term if i == j else 2 * term)
    return out


def _inverted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per group: its covariance plus the floor, inverted."""
    floor = np.diag(np.square(FLOOR))
    for pdf in frames:
        inverse = [np.linalg.inv(CONSISTENCY * np.reshape(c, (DIM, DIM)) + floor).ravel() for c in pdf["c"]]
        yield pd.DataFrame({"g": pdf["g"], "m": pdf["m"], "w": inverse})


def _invert(moments: DataFrame) -> DataFrame:
    return settle(moments.mapInPandas(_inverted, "g string, m array<double>, w array<double>"))


def estimate(rows: DataFrame) -> DataFrame:
    """``rows``: g, x0 to x5.  Per group g: centre m and inverse scatter w."""
    xs = [F.col(f"x{i}") for i in range(DIM)]
    # 1.4826 times the median deviation estimates a standard deviation.
    mid = settle(rows.groupBy("g").agg(F.array(*[F.percentile_approx(x, 0.5, 10_000) for x in xs]).alias("m")))
    near = rows.join(mid, "g")
    spread = near.groupBy("g", "m").agg(
        *[F.percentile_approx(F.abs(xs[i] - F.col("m")[i]), 0.5, 10_000).alias(f"d{i}") for i in range(DIM)]
    )
    diagonal = [F.pow(1.4826 * F.col(f"d{i}"), 2) if i == j else F.lit(0.0) for i in range(DIM) for j in range(DIM)]
    now = _invert(spread.select("g", "m", F.array(*diagonal).alias("c")))
    for _ in range(STEPS):
        far = rows.join(now, "g").select("g", *xs, _distance().alias("d"))
        edge = settle(far.groupBy("g").agg(F.percentile_approx("d", SUPPORT, 10_000).alias("edge")))
        kept = far.join(edge, "g").filter(F.col("d") <= F.col("edge"))
        moments = kept.groupBy("g").agg(
            F.array(*[F.avg(x) for x in xs]).alias("m"),
            F.array(*[F.covar_pop(a, b) for a in xs for b in xs]).alias("c"),
        )
        now = _invert(moments)
    return now


def judge(
    docs: DataFrame, key: str = "doc_id", lang: str = "lang", source: str = "source", text: str = "text", cutoff: float = CUTOFF
) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept and ``distance``."""
    read = docs.select(
        F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text")
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    counted = settle(counts(read).withColumn("base_failed", failed))
    rows = settle(
        _grouped(counted.select("*", *[x.alias(f"x{i}") for i, x in enumerate(_vector())])).select(
            "doc_id", *COUNTS, "base_failed", "g", *[f"x{i}" for i in range(DIM)]
        )
    )
    fitted = estimate(rows.filter(~F.col("base_failed")))
    return rows.join(fitted, "g", "left").select(
        "doc_id",
        *COUNTS,
        "base_failed",
        (~F.col("base_failed") & (F.coalesce(_distance(), F.lit(0.0)) <= cutoff)).alias("kept"),
        _distance().alias("distance"),
    )
