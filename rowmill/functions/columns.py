"""Column families and the missing-value convention.

A value is *missing* when it is NULL or, in a float column, NaN.  Every
operator goes through these helpers so both spellings behave the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.FloatType, T.DoubleType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Reference a top-level column whose name may contain dots or spaces."""
    return F.col(quoted(name))


def family(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "categorical"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "other"


def families(df: DataFrame) -> dict[str, list[str]]:
    """Column names of each type family, in table order."""
    out: dict[str, list[str]] = {
        k: [] for k in ("numeric", "categorical", "datetime", "boolean", "other")
    }
    for field in df.schema.fields:
        out[family(field.dataType)].append(field.name)
    return out


def numeric_columns(df: DataFrame) -> list[str]:
    return families(df)["numeric"]


def categorical_columns(df: DataFrame) -> list[str]:
    return families(df)["categorical"]


def project_family(df: DataFrame, *kinds: str) -> DataFrame:
    """Keep only the columns of the given type families."""
    groups = families(df)
    keep = [f.name for f in df.schema.fields if any(f.name in groups[k] for k in kinds)]
    return df.select(*[col(c) for c in keep])


def is_missing(df: DataFrame, name: str) -> Column:
    test = col(name).isNull()
    if isinstance(df.schema[name].dataType, FLOATS):
        test = test | F.isnan(col(name))
    return test


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL, type unchanged."""
    if isinstance(df.schema[name].dataType, FLOATS):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def number(df: DataFrame, name: str) -> Column:
    """The column as double, missing as NULL."""
    return present(df, name).cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Normalise a whole table so that NULL is its only missing marker."""
    return df.select(*[present(df, f.name).alias(f.name) for f in df.schema.fields])


def digest(c: Column, longest: int = 64) -> Column:
    """A grouping key that stays short: long strings become length-tagged
    SHA-256 digests, so equality tests never shuffle whole documents."""
    tagged = F.concat(F.length(c).cast("string"), F.lit(":"), F.sha2(c, 256))
    return F.when(F.length(c) > longest, tagged).otherwise(c)


def long_rows(df: DataFrame, columns: list[str], fields: dict) -> DataFrame:
    """Reshape a one-row aggregate into one row per column.

    ``fields`` maps an output name to ``f(column) -> Column`` over ``df``.
    """
    rows = [
        F.struct(F.lit(c).alias("column"), *[f(c).alias(k) for k, f in fields.items()])
        for c in columns
    ]
    return df.select(F.inline(F.array(*rows)))
