"""Quality classifier by compression.

Two zstandard dictionaries are built from good and bad labelled texts.  A text
is compressed in blocks with each; the size difference divided by the sum
says which side it is nearer to.  A logistic calibration turns that difference,
its worst blocks and the compressed sizes into the probability of label 1 at the
labels' own shares.

Only fitting uses a sample: per label at most ``Fit.rows`` documents for the
dictionaries and as many others for the calibration, chosen by a hash of the id
so that the same rows are taken wherever they lie; both uses get a share of every
label of two or more documents.  Every text is scored whole.

Defined results: a NULL or empty text scores like a text of no evidence (the
calibration's value at feature 0); rows are scored separately, repeated or not;
without two labelled texts of either kind every score is 0.5; an empty table gives no rows;
labels, ids, languages and sources are never inputs of a score; only the id and
text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowmill.functions.storage import settle

THRESHOLD = 0.7


@dataclass(frozen=True)
class Fit:
    """Documented bounds of the fit: labelled rows per label for either use,
    bytes per dictionary, bytes per compressed block, zstandard level."""

    rows: int = 1500
    dictionary: int = 128 * 1024
    block: int = 2048
    level: int = 6
    ridge: float = 1e-3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    fit: Fit


FEATURES = 8


class Sizes:
    """Compressed sizes with and without the dictionaries; one per task."""

    def __init__(self, good: bytes, bad: bytes, fit: Fit):
        make = lambda d: zstandard.ZstdCompressor(
            level=fit.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        raw = [zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for x in (good, bad)]
        for d in raw:
            d.precompute_compress(level=fit.level)
        self._with = [make(d) for d in raw]
        self._plain = zstandard.ZstdCompressor(level=fit.level, write_content_size=False)
        self._fit = fit

    def features(self, text: str | None) -> np.ndarray:
        data = (text or "").encode()
        if not data.strip():
            return np.zeros(FEATURES)
        parts = [data[i : i + self._fit.block] for i in range(0, len(data), self._fit.block)]
        good, bad = (np.array([len(c.compress(p)) for p in parts], float) for c in self._with)
        size = np.array([len(p) for p in parts], float)
        gap = (bad - good) / (bad + good)
        # Short tail blocks say little of themselves.
        solid = gap[size >= min(256, size.max())]
        ratio = good / size
        whole = min(1.0, len(self._plain.compress(data)) / len(data))
        mean, total = (bad.sum() - good.sum()) / (bad.sum() + good.sum()), good.sum() / size.sum()
        # What a size difference means depends on how much was compressed.
        long = min(8.0, np.log1p(len(data)))
        return np.array([mean, solid.min(), ratio.min(), total, whole, long, long * mean, long * total])


def _side(texts: list[str], limit: int) -> bytes:
    """Raw dictionary content: an equal share of each text, the first of them
    nearest to the data."""
    if not texts:
        return b" " * 8
    share = max(64, limit // len(texts))
    taken, held = [], 0
    for text in texts:
        data = text.encode()
        # The middle of a text, where its body is.
        at = max(0, (len(data) - share) // 2)
        part = data[at : at + share]
        if held + len(part) > limit:
            break
        taken.append(part)
        held += len(part)
    return b"\n".join(reversed(taken)) or b" " * 8


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Newton's method with both labels of equal weight in sum."""
    mean, std = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / std])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + ridge * np.r_[0, w[1:]]
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    out = w[1:] / std
    return np.r_[w[0] - out @ mean, out]


def _probability(x: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    w = np.asarray(weights)
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


def _shape(x: np.ndarray) -> np.ndarray:
    """Calibration inputs: the features and their squares."""
    return np.hstack([x, x**2])


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model | None:
    """``docs``: doc_id, text; ``labels``: doc_id, good (boolean)."""
    order = F.xxhash64("doc_id")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("good").isNotNull()).select("doc_id", "good").distinct()
    picked = [
        known.filter(F.col("good") == good).orderBy(order, "doc_id").limit(2 * fit.rows) for good in (True, False)
    ]
    sample = docs.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").filter(F.length(F.trim("text")) > 0)
    sample = settle(sample.select("doc_id", "good", "text"))
    # Halves by hash; a label that lies in one of them whole is dealt in turn, so that both hold each label of two or more.
    by = W.partitionBy("good")
    half = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)) == 0
    turn = F.row_number().over(by.orderBy(order, "doc_id")) % 2 == 1
    halves = sample.select("doc_id", "good").distinct().withColumn("half", half)
    whole = F.min("half").over(by) == F.max("half").over(by)
    halves = halves.withColumn("build", F.when(whole, turn).otherwise(F.col("half"))).drop("half")
    rows = sample.join(F.broadcast(halves), ["doc_id", "good"]).select("good", "text", "build", order.alias("o"))
    # A document gives the dictionary its middle only: what it holds is bounded.
    share = 4 * max(64, fit.dictionary // max(1, fit.rows))
    middle = F.substring(F.col("text"), F.greatest(F.lit(1), (F.length("text") / 2 - share / 2).cast("int")), F.lit(share))
    build = rows.filter("build").select("good", middle.alias("text"), "o").toPandas().sort_values(["o", "text"])
    sides = [build[build.good == g].text.tolist() for g in (True, False)]
    if not all(sides):
        return None
    good, bad = (_side(s, fit.dictionary) for s in sides)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = Sizes(good, bad, fit)
        for pdf in frames:
            x = np.array([sizes.features(t) for t in pdf.text]).reshape(-1, FEATURES)
            yield pd.DataFrame({"good": pdf.good.to_numpy(), **{f"x{i}": x[:, i] for i in range(FEATURES)}})

    columns = ", ".join(f"x{i} double" for i in range(FEATURES))
    held = rows.filter("not build").select("good", "text").mapInPandas(measure, f"good boolean, {columns}").toPandas()
    if held.good.nunique() < 2:
        return None
    held = held.sort_values(list(held.columns))
    x = _shape(held[[f"x{i}" for i in range(FEATURES)]].to_numpy())
    weights = _logistic(x, held.good.to_numpy().astype(float), fit.ridge)
    # The sample has both labels in equal weight; the corpus has not.
    count = known.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).first()
    weights[0] += np.log(count["good"] / count["bad"])
    return Model(good, bad, tuple(weights), fit)


def score(docs: DataFrame, model: Model | None, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the column ``into``, the probability of label 1."""
    if model is None:
        return docs.withColumn(into, F.lit(0.5))

    @F.pandas_udf("double")
    def probability(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = Sizes(model.good, model.bad, model.fit)
        for texts in frames:
            x = np.array([sizes.features(t) for t in texts]).reshape(-1, FEATURES)
            yield pd.Series(_probability(_shape(x), model.weights))

    return docs.withColumn(into, probability(F.col(text)))


def held_out(key: str = "doc_id"):
    """Rows that no fit may use: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def learn(spark: SparkSession, sf_dir: str, fit: Fit = Fit()) -> Model | None:
    """The model of ``labels`` and ``documents`` in a folder of tables."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return train(docs, labels.select("doc_id", (F.col("quality") == 1).alias("good")), fit)
