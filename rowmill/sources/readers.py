"""Table readers: CSV, JSON and Parquet with detection and validation."""

from __future__ import annotations

import os
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.functions.columns import col
from rowmill.sources.records import read_records

# Extensions, separators and encodings in the order tried.
EXTENSIONS = {".csv": "csv", ".json": "json", ".parquet": "parquet"}
UPLOAD_TYPES = ("csv", "json", "parquet")
SEPARATORS = [",", ";", "\t", "|"]
DATA_KEY = "data"
PREVIEW_ROWS = 10
# Texts that stand for a missing value, and for infinity.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
INFINITE = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")


def detect_file_type(path: str) -> str:
    """By extension; anything unknown is read as CSV."""
    return EXTENSIONS.get(os.path.splitext(path.lower())[1], "csv")


def allowed_file(path: str) -> bool:
    return "." in path and path.rsplit(".", 1)[1].lower() in UPLOAD_TYPES


#: Bytes of the first line that reach the driver.
HEAD_BYTES = 65536


def _head(spark: SparkSession, path: str) -> tuple[bytes, str]:
    """The start of the first line, cut on the executor, and its last character."""
    line = F.col("value").cast("binary")
    first = (
        spark.read.text(path)
        .limit(1)
        .select(F.substring(line, 1, HEAD_BYTES).alias("head"), F.right(F.rtrim("value"), F.lit(1)).alias("last"))
        .collect()
    )
    return (bytes(first[0]["head"]), first[0]["last"]) if first else (b"", "")


def sniff_separator(line: str) -> str:
    """The first separator that splits the header into several columns; what
    stands in quotes does not count."""
    bare = re.sub(r'"[^"]*"', "", line)
    for sep in SEPARATORS:
        if sep in bare:
            return sep
    return SEPARATORS[0]


def sniff_encoding(spark: SparkSession, path: str) -> str:
    """utf-8 unless some line is not valid utf-8, then latin-1.

    Checked by the executors over the whole input; name the encoding when
    reading large files to save that pass.
    """
    bad = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1)
    return "UTF-8" if bad.isEmpty() else "ISO-8859-1"


def _refuse_open_quotes(spark: SparkSession, path: str, sep: str) -> None:
    """A line that leaves a quoted value open is part of a record that goes on
    in the next line.  Quotes inside an unquoted field are text."""
    field = rf'"(?:[^"]|"")*"[^{re.escape(sep)}]*|[^"{re.escape(sep)}][^{re.escape(sep)}]*|'
    whole = F.col("value").rlike(rf"^(?:{field})(?:{re.escape(sep)}(?:{field}))*$")
    if not spark.read.text(path).filter(F.contains("value", F.lit('"')) & ~whole).limit(1).isEmpty():
        raise ValueError("a quoted value goes over several lines: read with multi_line=True")


def _kinds(text: Column) -> dict[str, Column]:
    """Type -> whether a text is one of its values, narrowest type first."""
    number = text.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$") | F.lower(F.trim(text)).isin(*INFINITE)
    whole = text.rlike(r"^\s*[+-]?[0-9]+\s*$")
    return {
        "int": whole & text.try_cast("int").isNotNull(),
        "bigint": whole & text.try_cast("bigint").isNotNull(),
        "double": number,
        "boolean": F.lower(F.trim(text)).isin("true", "false"),
        "date": text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & text.try_cast("date").isNotNull(),
        "timestamp": text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}") & text.try_cast("timestamp").isNotNull(),
    }


def _inferred(df: DataFrame) -> list[str]:
    """The narrowest type that holds all values of each text column, in one pass."""
    facts = df.agg(
        *[
            F.struct(
                F.count(col(c)).alias("n"), *[F.count_if(hit).alias(kind) for kind, hit in _kinds(col(c)).items()]
            ).alias(f"s{i}")
            for i, c in enumerate(df.columns)
        ]
    ).first()
    return [next((k for k in _kinds(F.lit("")) if row["n"] and row[k] == row["n"]), "string") for row in facts]


def _typed(text: Column, kind: str) -> Column:
    if kind == "string":
        return text
    if kind in ("float", "double"):
        sign = F.when(F.trim(text).startswith("-"), float("-inf")).otherwise(float("inf"))
        return F.when(F.lower(F.trim(text)).isin(*INFINITE), sign).otherwise(text.try_cast(kind)).cast(kind)
    return text.try_cast(kind)


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    encoding: str | None = None,
    schema: str | None = None,
    multi_line: bool = False,
    null_values: tuple[str, ...] = MISSING,
    rejects: str | None = None,
) -> DataFrame:
    """CSV with header; quotes are doubled inside quoted values, and a quote
    that does not start a field is text.

    Values equal to one of ``null_values`` are missing, and types are inferred
    from the rest; give ``schema`` at scale, since inference is a full pass.  Its
    columns are taken by name where the header has them all, else by position,
    and a value that is not of its type raises when it is read; ``rejects`` names
    a column that lists such columns instead, their values being NULL.
    ``multi_line`` allows line breaks inside quotes; without it such a file is refused.
    """
    encoding = encoding or sniff_encoding(spark, path)
    sep = sep or sniff_separator(_head(spark, path)[0].decode("utf-8", "replace"))
    options = {"sep": sep, "encoding": encoding, "quote": '"', "escape": '"'}
    wanted = T.StructType.fromDDL(schema) if schema else None
    if multi_line:
        df = _from_records(read_records(spark, path, sep, encoding), options, wanted)
    else:
        _refuse_open_quotes(spark, path, sep)
        df = spark.read.options(header=True, **options).csv(path)
    if wanted:
        named = set(wanted.names) <= set(df.columns)
        if not named and len(df.columns) != len(wanted):
            raise ValueError(f"the header has {len(df.columns)} columns, the schema {len(wanted)}")
        df = df.select(*[col(c) for c in wanted.names]) if named else df.toDF(*wanted.names)
    df = df.select(*[F.when(~col(c).isin(*null_values), col(c)).alias(c) for c in df.columns])
    kinds = [f.dataType.simpleString() for f in wanted] if wanted else _inferred(df)
    pairs = list(zip(df.columns, kinds, strict=True))
    typed = [_typed(col(c), k) for c, k in pairs]
    if not wanted:
        return df.select(*[t.alias(c) for t, (c, _) in zip(typed, pairs)])
    lost = [col(c).isNotNull() & t.isNull() for t, (c, _) in zip(typed, pairs)]
    if rejects:
        listed = F.filter(F.array(*[F.when(x, F.lit(c)) for x, (c, _) in zip(lost, pairs)]), lambda v: v.isNotNull())
        return df.select(*[t.alias(c) for t, (c, _) in zip(typed, pairs)], listed.alias(rejects))
    fail = lambda c, k: F.raise_error(F.format_string(f"column {c}: '%s' is no {k}", col(c))).cast(k)
    return df.select(*[F.when(x, fail(c, k)).otherwise(t).alias(c) for x, t, (c, k) in zip(lost, typed, pairs)])


def _from_records(records: DataFrame, options: dict, wanted: T.StructType | None) -> DataFrame:
    """Text columns of whole records, parsed by Spark; the header names them."""
    parts = {k: v for k, v in options.items() if k != "encoding"}
    head = records.filter("first").orderBy("file").limit(1).collect()
    if not head:
        return records.select().limit(0)
    # The header's width is that of its own parsing.
    count = head[0]["record"].count(options["sep"]) + 1
    probe = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(count)])
    one = records.sparkSession.createDataFrame([(head[0]["record"],)], "record string")
    cells = list(one.select(F.from_csv("record", probe.simpleString()[7:-1].replace(":", " "), parts).alias("r")).first()["r"])
    while cells and cells[-1] is None:
        cells.pop()
    names = [c if c else f"_c{i}" for i, c in enumerate(cells)]
    ddl = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = records.filter("not first").select(F.from_csv("record", ddl, parts).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool | None = None) -> DataFrame:
    """JSON records: a list, ``{"data": [...]}``, one object, or one per line.

    Line-delimited input is split over tasks; a document is one task, since a
    JSON document cannot be cut.
    """
    if lines is None:
        head, last = _head(spark, path)
        lines = head.strip().startswith(b"{") and last == "}"
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.option("multiLine", not lines).json(path)
    if DATA_KEY in df.columns and df.schema[DATA_KEY].dataType.simpleString().startswith("array<struct"):
        return df.select(F.inline(F.col(DATA_KEY)))
    return df


def load_table(spark: SparkSession, path: str, file_type: str | None = None, **options) -> DataFrame:
    """Read by type, then refuse tables without rows or columns."""
    kind = (file_type or detect_file_type(path)).lower()
    try:
        if kind == "csv":
            df = read_csv(spark, path, **options)
        elif kind == "json":
            df = read_json(spark, path, **options)
        elif kind == "parquet":
            df = spark.read.parquet(path)
        else:
            raise ValueError(f"no reader for file type {kind!r}")
    except AnalysisException as e:
        raise ValueError(f"{path} cannot be read as {kind}: {e}") from e
    return validate(df)


def validate(df: DataFrame) -> DataFrame:
    if not df.columns:
        raise ValueError("the table has no columns")
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> dict:
    """Columns, types, shape and the first rows (the limit reaches the scan)."""
    return {
        "columns": df.columns,
        "dtypes": dict(df.dtypes),
        "shape": (df.count(), len(df.columns)),
        "data": df.limit(rows),
    }
