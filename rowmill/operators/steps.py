"""Fitted preparation steps.

A step is a kind, a small JSON-able state and, where the fitted parameters grow
with the data (category codes, target means), tables.  ``transform`` is pure
projection, filter or lookup join, so a fitted step also runs on other batches
and on streams.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.functions.columns import col

_APPLY: dict[str, Callable] = {}


def applies(kind: str) -> Callable:
    """Register the transform of a step kind."""

    def keep(fn: Callable) -> Callable:
        _APPLY[kind] = fn
        return fn

    return keep


@dataclass
class Step:
    kind: str
    state: dict = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return _APPLY[self.kind](df, self.state, self.tables)


@dataclass
class Chain:
    """Fitted steps in order; itself a transform that can be saved."""

    steps: list[Step] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df

    def parameters(self, spark: SparkSession) -> DataFrame:
        """The fitted state as ``(position, step, param, value)`` rows."""
        rows = [
            (i, s.kind, k, json.dumps(v, sort_keys=True))
            for i, s in enumerate(self.steps)
            for k, v in sorted(s.state.items())
        ]
        return spark.createDataFrame(rows, "position int, step string, param string, value string")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the state as JSON lines and every table as Parquet."""
        rows = [
            (i, s.kind, json.dumps(s.state), sorted(s.tables)) for i, s in enumerate(self.steps)
        ]
        frame = spark.createDataFrame(rows, "position int, kind string, state string, tables array<string>")
        frame.coalesce(1).write.mode("overwrite").json(f"{path}/steps")
        for i, step in enumerate(self.steps):
            for name, table in step.tables.items():
                table.write.mode("overwrite").parquet(f"{path}/tables/{i}_{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Chain:
        schema = "position int, kind string, state string, tables array<string>"
        rows = spark.read.schema(schema).json(f"{path}/steps").orderBy("position").collect()
        return cls(
            [
                Step(
                    r["kind"],
                    json.loads(r["state"]),
                    {t: spark.read.parquet(f"{path}/tables/{r['position']}_{t}") for t in r["tables"]},
                )
                for r in rows
            ]
        )


@applies("drop_columns")
def _drop_columns(df: DataFrame, state: dict, tables: dict) -> DataFrame:
    return df.drop(*state["columns"])


@applies("drop_duplicates")
def _drop_duplicates(df: DataFrame, state: dict, tables: dict) -> DataFrame:
    return df.dropDuplicates()


@applies("select")
def _select(df: DataFrame, state: dict, tables: dict) -> DataFrame:
    return df.select(*[col(c) for c in state["columns"]])


def align_features(df: DataFrame, expected: list[str], keep: list[str] | None = None) -> DataFrame:
    """Project to the training columns: absent ones become 0, extras go."""
    have = set(df.columns)
    return df.select(
        *[col(c) for c in keep or []],
        *[col(c) if c in have else F.lit(0).alias(c) for c in expected],
    )
