"""Profiler queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.operators import profile as P
from rowmill.operators import target as T
from rowmill.plans.catalog.base import (
    GAP_COLUMNS,
    GAPS,
    KEYS,
    MEASURES,
    gaps,
    query,
    r,
    table,
    tidy,
)

NUMERIC = KEYS + MEASURES


def _numeric_sql(source: str, columns: list[str]) -> str:
    part = """select '{c}' as "column", count({c}) as count, {mean} as mean, {std} as std, {lo} as min, {hi} as max,
      {skew} as skewness,
      cast(count(case when {c} < q[1] - 1.5 * (q[3] - q[1]) or {c} > q[3] + 1.5 * (q[3] - q[1]) then 1 end) as bigint) as outliers,
      {q1} as q25, {q2} as median, {q3} as q75, count(*) - count({c}) as missing
    from {s}, (select quantile_cont(cast({c} as double), [0.25, 0.5, 0.75]) as q from {s})"""
    rows = [
        part.format(
            c=c,
            s=source,
            mean=r(f"avg({c})"),
            std=r(f"stddev_samp({c})"),
            lo=r(f"cast(min({c}) as double)"),
            hi=r(f"cast(max({c}) as double)"),
            skew=r(f"skewness({c})"),
            q1=r("any_value(q[1])"),
            q2=r("any_value(q[2])"),
            q3=r("any_value(q[3])"),
        )
        for c in columns
    ]
    return "\nunion all\n".join(rows)


@query("profile_numeric", _numeric_sql("lineitem", NUMERIC))
def profile_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(P.numeric_profile(table(spark, sf, "lineitem")))


@query(
    "profile_numeric_gaps",
    f"with {GAPS} " + _numeric_sql("gaps", ["o_orderkey", "o_totalprice", "g_mean", "g_median", "g_knn", "g_drop"]),
)
def profile_numeric_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(P.numeric_profile(gaps(spark, sf)))


def _counts_sql(source: str, columns: list[str]) -> str:
    rows = [
        f"""select '{c}' as "column", {c} as value, count(*) as n from {source} where {c} is not null group by {c}"""
        for c in columns
    ]
    return "vc as (" + " union all ".join(rows) + ")"


PART_STRINGS = ["p_name", "p_brand", "p_type"]


@query(
    "profile_categorical",
    f"""with {_counts_sql("part", PART_STRINGS)},
    ranked as (select *, row_number() over (partition by "column" order by n desc, value) as m,
      row_number() over (partition by "column" order by value) as f from vc)
    select "column", count(*) as n_distinct, cast(sum(n) as bigint) as n_values,
      max(case when m = 1 then value end) as mode, max(n) as mode_count,
      string_agg(case when f <= 20 then value end, '|' order by f) as first_values
    from ranked group by "column" """,
)
def profile_categorical(spark: SparkSession, sf: str) -> DataFrame:
    return P.categorical_profile(P.value_counts(table(spark, sf, "part"), PART_STRINGS))


TOP_COLUMNS = ["o_orderstatus", "o_orderpriority", "g_cat"]


@query(
    "top_values",
    f"""with {GAPS}, {_counts_sql("gaps", TOP_COLUMNS)}
    select "column", value, n, cast(position as int) as position from (
      select *, row_number() over (partition by "column" order by n desc, value) as position from vc)
    where position <= 10""",
)
def top_values(spark: SparkSession, sf: str) -> DataFrame:
    return P.top_values(P.value_counts(gaps(spark, sf), TOP_COLUMNS))


@query(
    "distinct_counts",
    "\nunion all\n".join(
        f"""select '{c}' as "column", count(distinct {c}) as n_distinct from documents""" for c in ("text", "lang", "source")
    ),
)
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.distinct_counts(table(spark, sf, "documents"), ["text", "lang", "source"])


@query("distinct_counts_approx")
def distinct_counts_approx(spark: SparkSession, sf: str) -> DataFrame:
    return P.distinct_counts(table(spark, sf, "part"), PART_STRINGS, approximate=True)


_PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i:]]


@query(
    "correlation",
    "\nunion all\n".join(
        f"select '{a}' as a, '{b}' as b, {r(f'corr({a}, {b})')} as corr from lineitem" for a, b in _PAIRS
    ),
)
def correlation(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(P.correlation(table(spark, sf, "lineitem")))



#: Components of the embeddings.
_WIDTH = 64


@query(
    "correlation_blocks",
    f"""select 'v' || i as a, 'v' || j as b, {r("corr(embedding[i + 1], embedding[j + 1])")} as corr
    from embeddings, range({_WIDTH}) x(i), range({_WIDTH}) y(j) where i <= j and len(embedding) = {_WIDTH} group by i, j""",
)
def correlation_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The components of the embeddings as columns, in blocks of 20."""
    rows = table(spark, sf, "embeddings").filter(F.size("embedding") == _WIDTH)
    wide = rows.select(*[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(_WIDTH)])
    return tidy(P.correlation(wide, block=20))


@query(
    "correlation_pairwise_complete",
    f"with {GAPS} "
    + "\nunion all\n".join(
        f"select '{a}' as a, '{b}' as b, {r(f'corr({a}, {b} + o_orderkey)')} as corr, count(*) as n "
        f"from gaps where {a} is not null and {b} is not null"
        for a, b in [("g_mean", "g_median"), ("g_mean", "g_knn"), ("g_median", "g_knn")]
    ),
)
def correlation_pairwise_complete(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs whose second member is shifted by the key, so they are not 1."""
    df = gaps(spark, sf)
    parts = []
    for a, b in [("g_mean", "g_median"), ("g_mean", "g_knn"), ("g_median", "g_knn")]:
        both = df.select(a, (F.col(b) + F.col("o_orderkey")).alias(b))
        found = P.correlation(both).filter("a <> b")
        n = both.filter(f"{a} is not null and not isnan({a}) and {b} is not null and not isnan({b})")
        parts.append(found.withColumn("n", n.agg(F.count(F.lit(1))).scalar()))
    return tidy(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(
    "skewness",
    "\nunion all\n".join(f"""select '{c}' as "column", {r(f"skewness({c})")} as skewness from lineitem""" for c in NUMERIC),
)
def skewness(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(P.skewness(table(spark, sf, "lineitem")))


@query(
    "table_shape",
    """select count(*) as n_rows, 11::bigint as n_columns, count(*) * 11 as n_cells, 8::bigint as n_numeric,
    2::bigint as n_categorical, 1::bigint as n_datetime, 0::bigint as n_boolean from lineitem""",
)
def table_shape(spark: SparkSession, sf: str) -> DataFrame:
    return P.shape(table(spark, sf, "lineitem"))


@query(
    "family_projection",
    f"select {', '.join(r(c) + ' as ' + c if c in MEASURES else c for c in NUMERIC)} from lineitem",
)
def family_projection(spark: SparkSession, sf: str) -> DataFrame:
    from rowmill.functions.columns import project_family

    return tidy(project_family(table(spark, sf, "lineitem"), "numeric"))


@query(
    "missing_report",
    f"with {GAPS} "
    + "\nunion all\n".join(
        f"""select '{c}' as "column", count(*) - count({c}) as missing,
        {r(f"(count(*) - count({c})) * 100.0 / count(*)")} as missing_pct from gaps"""
        for c in GAP_COLUMNS
    ),
)
def missing_report(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(P.missing_report(gaps(spark, sf)))


@query(
    "outlier_counts",
    "\nunion all\n".join(
        f"""select '{c}' as "column", count(case when {c} < q[1] - 1.5 * (q[2] - q[1]) or {c} > q[2] + 1.5 * (q[2] - q[1])
        then 1 end) as outliers from events, (select quantile_cont(cast({c} as double), [0.25, 0.75]) as q from events)"""
        for c in ("event_id", "user_id", "value")
    ),
)
def outlier_counts(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events")
    return P.outlier_counts(df, P.iqr_bounds(df, ["event_id", "user_id", "value"]))


@query(
    "duplicate_rows",
    """select (select count(*) from documents) - (select count(*) from
    (select distinct text, lang from documents)) as duplicate_rows""",
)
def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return P.duplicate_rows(table(spark, sf, "documents").select("text", "lang"))


_MISSING = " + ".join(f"(count(*) - count({c}))" for c in GAP_COLUMNS)


@query(
    "quality_score",
    """with d as (select text, lang, case when doc_id % 5 < 2 then source end as source, 'x' as fixed from documents),
    f as (select count(*) as n_rows, (count(*) - count(source)) as missing_cells,
      count(*) - (select count(*) from (select distinct * from d)) as duplicate_rows,
      count(distinct text) as dt, count(distinct lang) as dl, count(distinct source) as ds from d),
    g as (select *, missing_cells * 100.0 / (n_rows * 4) as pct,
      1 + (dt <= 1)::int + (dl <= 1)::int + (ds <= 1)::int as k,
      (dt > n_rows * 0.5)::int + (dl > n_rows * 0.5)::int + (ds > n_rows * 0.5)::int as h from f)
    select n_rows, missing_cells, """
    + r("pct")
    + """ as missing_pct, duplicate_rows, 'fixed' as constant_columns, 'text' as high_cardinality_columns,
      concat_ws('; ', case when pct > 50 then 'High percentage of missing values (>50%)'
        when pct > 20 then 'Moderate missing values (>20%)' end,
        case when duplicate_rows > 0 then duplicate_rows || ' duplicate rows found' end,
        'Constant columns found: fixed', 'High cardinality categorical columns: text') as issues,
      """
    + r(
        "greatest(0, 100.0 - case when pct > 50 then 30 when pct > 20 then 15 else 0 end"
        " - least(20, duplicate_rows * 100.0 / n_rows) - 5 * k - 10 * h)"
    )
    + " as quality_score from g",
)
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "documents").select(
        "text",
        "lang",
        F.when(F.col("doc_id") % 5 < 2, F.col("source")).alias("source"),
        F.lit("x").alias("fixed"),
    )
    return tidy(P.quality(df))


@query(
    "recommendations",
    f"""with {GAPS}, m as (select ({_MISSING}) * 100.0 / (count(*) * {len(GAP_COLUMNS)}) as pct from gaps),
    o as ("""
    + " union all ".join(
        f"""select '{c}' as c, count(case when {c} < q[1] - 1.5 * (q[2] - q[1]) or {c} > q[2] + 1.5 * (q[2] - q[1])
        then 1 end) as k from gaps, (select quantile_cont(cast({c} as double), [0.25, 0.75]) as q from gaps)"""
        for c in ("o_orderkey", "o_totalprice", "g_mean", "g_median", "g_knn", "g_drop")
    )
    + """), d as (select 'o_orderstatus' as c, count(distinct o_orderstatus) as k from gaps union all
      select 'o_orderpriority', count(distinct o_orderpriority) from gaps union all
      select 'g_cat', count(distinct g_cat) from gaps)
    select 'impute' as rule, '' as "column" from m where pct > 5
    union all select 'scale', ''
    union all select 'treat_outliers', c from o where k > 0
    union all select 'target_encode', c from d where k > 20
    union all select 'one_hot', '' from d having max(k) <= 20""",
)
def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return P.recommendations(gaps(spark, sf))


@query(
    "recommendations_events",
    """with o as ("""
    + " union all ".join(
        f"""select '{c}' as c, count(case when {c} < q[1] - 1.5 * (q[2] - q[1]) or {c} > q[2] + 1.5 * (q[2] - q[1])
        then 1 end) as k from events, (select quantile_cont(cast({c} as double), [0.25, 0.75]) as q from events)"""
        for c in ("event_id", "user_id", "value")
    )
    + """), d as (select 'event_type' as c, count(distinct event_type) as k from events union all
      select 'props', count(distinct props) from events)
    select 'scale' as rule, '' as "column"
    union all select 'treat_outliers', c from o where k > 0
    union all select 'target_encode', c from d where k > 20
    union all select 'one_hot', '' from d having max(k) <= 20""",
)
def recommendations_events(spark: SparkSession, sf: str) -> DataFrame:
    return P.recommendations(table(spark, sf, "events"))


@query(
    "summary_text",
    f"""with {GAPS}, f as (select count(*) as n, {_MISSING} as m,
      count(*) - (select count(*) from (select distinct * from gaps)) as d from gaps)
    select 'Dataset Shape: ' || n || ' rows, 9 columns' || chr(10) || 'Column Types: 6 numeric, 3 categorical' || chr(10)
      || 'Missing Values: ' || m || ' (' || printf('%.1f', m * 100.0 / (n * 9)) || '%)' || chr(10)
      || 'Duplicate Rows: ' || d as summary from f""",
)
def summary_text(spark: SparkSession, sf: str) -> DataFrame:
    return P.summary_text(gaps(spark, sf))


@query(
    "target_numeric",
    f"""select 'l_extendedprice' as target, count(distinct l_extendedprice) as n_distinct,
      count(*) - count(l_extendedprice) as missing, {r("(count(*) - count(l_extendedprice)) * 100.0 / count(*)")} as missing_pct,
      {r("avg(l_extendedprice)")} as mean, {r("quantile_cont(l_extendedprice, 0.5)")} as median,
      {r("stddev_samp(l_extendedprice)")} as std, {r("min(l_extendedprice)")} as min, {r("max(l_extendedprice)")} as max,
      {r("skewness(l_extendedprice)")} as skewness from lineitem""",
)
def target_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(T.target_report(table(spark, sf, "lineitem"), "l_extendedprice"))


@query(
    "target_classes",
    f"""with {GAPS}, c as (select g_cat as class, count(*) as n from gaps where g_cat is not null group by 1)
    select class, n, {r("n / sum(n) over ()")} as proportion from c""",
)
def target_classes(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(T.class_proportions(gaps(spark, sf), "g_cat"))


def _balance_sql(source: str, column: str) -> str:
    return f"""select count(*) as n_classes, min(n) as minority_size, max(n) as majority_size,
      {r("max(n) / min(n)")} as imbalance_ratio,
      case when max(n) / min(n) > 10 then 'highly_imbalanced' when max(n) / min(n) > 3 then 'moderately_imbalanced'
        when max(n) / min(n) > 1.5 then 'slightly_imbalanced' else 'balanced' end as status
    from (select count(*) as n from {source} where {column} is not null group by {column})"""


@query("class_balance", _balance_sql("labels", "toxic"))
def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(T.class_balance(table(spark, sf, "labels"), "toxic"))


@query("class_balance_orders", _balance_sql("orders", "o_orderstatus"))
def class_balance_orders(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(T.class_balance(table(spark, sf, "orders"), "o_orderstatus"))


def _problem_sql(source: str, column: str, text: bool) -> str:
    kind = (
        f"case when count(distinct {column}) = 2 then 'binary_classification' when count(distinct {column}) <= 20 "
        "then 'multiclass_classification' else 'high_cardinality_classification' end"
        if text
        else f"case when count(distinct {column}) / count(*) > 0.9 then 'regression' else 'discrete_regression' end"
    )
    return (
        f"select '{column}' as target, count(*) as n_rows, count(distinct {column}) as n_distinct, "
        f"{kind} as problem_type from {source}"
    )


_PROBLEMS = [
    ("lineitem", "l_linestatus", True),
    ("lineitem", "l_returnflag", True),
    ("part", "p_name", True),
    ("part", "p_brand", True),
    ("orders", "o_totalprice", False),
    ("lineitem", "l_discount", False),
    ("labels", "quality", False),
]


@query("problem_type", "\nunion all\n".join(_problem_sql(*p) for p in _PROBLEMS))
def problem_type(spark: SparkSession, sf: str) -> DataFrame:
    parts = [T.problem_type(table(spark, sf, t), c) for t, c, _ in _PROBLEMS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
