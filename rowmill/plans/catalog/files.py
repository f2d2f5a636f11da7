"""Reader and writer queries: whole tables written, read back, compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.functions.storage import checkpoint_folder
from rowmill.operators import profile as P
from rowmill.plans.catalog.base import query, r, table, tidy
from rowmill.sources.readers import load_table, preview
from rowmill.sources.writers import write_table


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/files/{uuid.uuid4().hex}"


_CUSTOMER = f"""select c_custkey, c_name, c_nationkey, {r("c_acctbal")} as c_acctbal, c_mktsegment from customer"""


def _typed(df: DataFrame) -> DataFrame:
    return tidy(
        df.select(
            F.col("c_custkey").cast("bigint").alias("c_custkey"),
            "c_name",
            F.col("c_nationkey").cast("int").alias("c_nationkey"),
            F.col("c_acctbal").cast("double").alias("c_acctbal"),
            "c_mktsegment",
        )
    )


@query("csv_roundtrip", _CUSTOMER)
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Semicolon-separated: the separator is found from the header."""
    path = _folder(spark) + ".csv"
    table(spark, sf, "customer").write.option("header", True).option("sep", ";").csv(path)
    return _typed(load_table(spark, path))


@query("csv_documents", "select doc_id, md5(text) as text_md5, lang, length(text) as n from documents")
def csv_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with quotes, separators and line breaks."""
    path = write_table(table(spark, sf, "documents"), _folder(spark) + ".csv", "csv")
    read = load_table(spark, path, multi_line=True, schema="doc_id bigint, text string, lang string, source string, n_chars bigint")
    return read.select("doc_id", F.md5("text").alias("text_md5"), "lang", F.length("text").cast("bigint").alias("n"))


@query(
    "csv_missing_tokens",
    f"""select o_orderkey, case when o_orderkey % 5 > 0 then {r("o_totalprice")} end as price,
      case when o_orderkey % 7 > 0 then o_orderstatus end as status, 'double' as price_type from orders""",
)
def csv_missing_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """NA, NaN and null written as text are missing, and the price stays a number."""
    path, k = _folder(spark) + ".csv", F.col("o_orderkey")
    price = F.when(k % 5 > 0, F.col("o_totalprice").cast("string")).otherwise(F.when(k % 2 == 0, "NA").otherwise("NaN"))
    status = F.when(k % 7 > 0, F.col("o_orderstatus")).otherwise("null")
    write_table(table(spark, sf, "orders").select(k, price.alias("price"), status.alias("status")), path, "csv")
    read = load_table(spark, path)
    kind = F.lit(dict(read.dtypes)["price"]).alias("price_type")
    return tidy(read.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "price", "status", kind))


@query("json_lines_roundtrip", _CUSTOMER)
def json_lines_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = write_table(table(spark, sf, "customer"), _folder(spark) + ".json", "json")
    return _typed(load_table(spark, path))


@query("json_wrapped_roundtrip", _CUSTOMER)
def json_wrapped_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """One ``{"data": [...]}`` document per market segment."""
    path = _folder(spark) + ".json"
    rows = table(spark, sf, "customer")
    packed = rows.groupBy("c_mktsegment", (F.col("c_custkey") % 16).alias("b")).agg(
        F.collect_list(F.struct(*rows.columns)).alias("data")
    )
    packed.select("data").write.json(path)
    return _typed(load_table(spark, path))


@query("parquet_roundtrip", _CUSTOMER)
def parquet_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = write_table(table(spark, sf, "customer"), _folder(spark) + ".parquet")
    return _typed(load_table(spark, path))


@query(
    "preview_shape",
    "select count(*) as n_rows, 5::bigint as n_columns, least(10, count(*)) as n_preview from customer",
)
def preview_shape(spark: SparkSession, sf: str) -> DataFrame:
    seen = preview(table(spark, sf, "customer"))
    return seen["data"].agg(
        F.lit(seen["shape"][0]).cast("bigint").alias("n_rows"),
        F.lit(seen["shape"][1]).cast("bigint").alias("n_columns"),
        F.count(F.lit(1)).alias("n_preview"),
    )


@query(
    "table_schema",
    """select position::int as position, "column", family, type, n from (values (0, 'event_id', 'numeric', 'bigint'),
      (1, 'ts', 'datetime', 'timestamp_ntz'), (2, 'user_id', 'numeric', 'bigint'), (3, 'event_type', 'categorical', 'string'),
      (4, 'value', 'numeric', 'double'), (5, 'props', 'categorical', 'string')) v(position, "column", family, type),
      (select count(*) as n from events)""",
)
def table_schema(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events")
    return P.schema_report(df).withColumn("n", df.agg(F.count(F.lit(1))).scalar())
