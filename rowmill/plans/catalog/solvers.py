"""Queries that check the own solvers step by step against SQL."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.operators import learn as L
from rowmill.operators.kmeans import fit_kmeans, numbered
from rowmill.plans import training as T
from rowmill.plans.catalog.base import query, r, table, tidy
from rowmill.sources import registry

_MIN_SPLIT = 50


def _splits_sql(base: str, features: list[str], sums: dict[str, str], n: str, worth: str, depth: int) -> str:
    """The best splits down to ``depth``.  ``base``: id, y and the features;
    ``sums``: aggregates per value; ``n`` and ``worth`` name them as {0}."""
    side = lambda text, by: text.format(*by)
    left, total = [f"l_{s}" for s in sums], [f"t_{s}" for s in sums]
    right = [f"(t_{s} - l_{s})" for s in sums]
    level = []
    for k in range(depth):
        running = ", ".join(
            f"sum({s}) over w as l_{s}, sum({s}) over (partition by node, feature) as t_{s}" for s in sums
        )
        level.append(f"""
    counts{k} as (select node, feature, value, {", ".join(f"{e} as {s}" for s, e in sums.items())} from long{k} group by node, feature, value),
    run{k} as (
      select node, feature, value as low, lead(value) over w as high, {running} from counts{k}
      window w as (partition by node, feature order by value)),
    best{k} as (
      select node, feature, low / 2 + high / 2 as threshold, {side(n, total)} as n,
        {side(worth, left)} + {side(worth, right)} - {side(worth, total)} as gain
      from run{k} where high is not null and {side(n, total)} >= {_MIN_SPLIT}
      qualify row_number() over (partition by node order by {side(worth, left)} + {side(worth, right)} desc, feature, low) = 1),
    long{k + 1} as (
      select 2 * l.node + (v.value > b.threshold)::int as node, l.id, l.y, l.feature, l.value
      from long{k} l join best{k} b on b.node = l.node join long{k} v on v.id = l.id and v.feature = b.feature)""")
    names = " ".join(f"when {i} then '{f}'" for i, f in enumerate(features))
    first = " union all ".join(f"select 1 as node, id, y, {i} as feature, {f}::double as value from base" for i, f in enumerate(features))
    found = " union all ".join(f"select * from best{k}" for k in range(depth))
    return f"""with base as ({base}), long0 as ({first}), {",".join(level)}
    select node::bigint as node, case feature {names} end as feature, {r("threshold")} as threshold, n::bigint as n, {r("gain", 2)} as gain
    from ({found})"""


def _splits(spark: SparkSession, model: L.Model) -> DataFrame:
    found = model.splits(spark).select("node", "feature", "threshold", F.col("n").cast("long").alias("n"), F.round("gain", 2).alias("gain"))
    return tidy(found)


_STATUS = ["F", "O", "P"]
_GINI = "({0} * {0} + {1} * {1} + {2} * {2})::double / nullif({0} + {1} + {2}, 0)"


_STATUS_SPLITS = _splits_sql(
    "select o_orderkey as id, o_orderstatus as y, o_totalprice, o_custkey, month(o_orderdate) as o_month from orders",
    ["o_totalprice", "o_custkey", "o_month"],
    {f"c{i}": f"count(*) filter (where y = '{s}')" for i, s in enumerate(_STATUS)},
    "({0} + {1} + {2})",
    _GINI,
    2,
)


@query("tree_splits_class", _STATUS_SPLITS)
def tree_splits_class(spark: SparkSession, sf: str) -> DataFrame:
    """Both levels of a classification tree, split over the whole table."""
    df = table(spark, sf, "orders").withColumn("o_month", F.month("o_orderdate").cast("double"))
    given = {"max_depth": 2, "min_samples_split": _MIN_SPLIT, "local_bytes": 0}
    return _splits(spark, L.fit(df, "decision_tree_classifier", ["o_totalprice", "o_custkey", "o_month"], "o_orderstatus", given))


@query(
    "tree_importance",
    f"""with found as ({_STATUS_SPLITS})
    select feature, {r("sum(gain) / (select sum(gain) from found)", 2)} as importance from found group by feature""",
)
def tree_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Each feature's share of the gain, of the features that split."""
    df = table(spark, sf, "orders").withColumn("o_month", F.month("o_orderdate").cast("double"))
    given = {"max_depth": 2, "min_samples_split": _MIN_SPLIT}
    model = L.fit(df, "decision_tree_classifier", ["o_totalprice", "o_custkey", "o_month"], "o_orderstatus", given)
    return tidy(model.importances(spark).filter("importance > 0"), 2)


@query(
    "logreg_shares",
    f"""select o_orderstatus as class, {r("count(*) / (select count(*) from orders)", 3)} as share from orders group by o_orderstatus""",
)
def logreg_shares(spark: SparkSession, sf: str) -> DataFrame:
    """At the optimum of a logistic regression the mean probability of a class is its share."""
    df = table(spark, sf, "orders").select((F.col("o_totalprice") / 1e5).alias("price"), "o_orderstatus")
    model = L.fit(df, "logistic_regression", ["price"], "o_orderstatus")
    shares = [F.avg(F.col("probability")[i]).alias(c) for i, c in enumerate(model.labels)]
    row = model.score(df).agg(*shares)
    return tidy(row.unpivot([], model.labels, "class", "share"), 3)


@query(
    "tree_splits_value",
    _splits_sql(
        "select row_number() over () as id, l_quantity as y, l_discount, l_tax, l_linenumber from lineitem",
        ["l_discount", "l_tax", "l_linenumber"],
        {"m": "count(*)", "s": "sum(y)"},
        "{0}",
        "({1} * {1})::double / nullif({0}, 0)",
        2,
    ),
)
def tree_splits_value(spark: SparkSession, sf: str) -> DataFrame:
    """Both levels of a regression tree, finished in memory."""
    given = {"max_depth": 2, "min_samples_split": _MIN_SPLIT}
    inputs = ["l_discount", "l_tax", "l_linenumber"]
    return _splits(spark, L.fit(table(spark, sf, "lineitem"), "decision_tree_regressor", inputs, "l_quantity", given))


@query(
    "tree_splits_wide",
    _splits_sql(
        "select row_number() over () as id, l_quantity as y, l_discount, l_tax, l_linenumber from lineitem",
        ["l_discount", "l_tax", "l_linenumber"],
        {"m": "count(*)", "s": "sum(y)"},
        "{0}",
        "({1} * {1})::double / nullif({0}, 0)",
        1,
    ),
)
def tree_splits_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The root of a regression tree, split over the whole table."""
    given = {"max_depth": 1, "min_samples_split": _MIN_SPLIT, "local_bytes": 0}
    inputs = ["l_discount", "l_tax", "l_linenumber"]
    return _splits(spark, L.fit(table(spark, sf, "lineitem"), "decision_tree_regressor", inputs, "l_quantity", given))


def _lloyd_sql(base: str, columns: list[str], k: int, steps: int) -> str:
    """Lloyd steps from the first ``k`` rows of ``base`` (id and the columns)."""
    near = lambda c: " + ".join(f"(v.{x} - {c}.{x}) * (v.{x} - {c}.{x})" for x in columns)
    level = []
    for s in range(steps + 1):
        level.append(f"""
    near{s} as (
      select v.*, c.cluster, {near("c")} as far from base v, c{s} c
      qualify row_number() over (partition by v.id order by {near("c")}, c.cluster) = 1),
    c{s + 1} as (select cluster, {", ".join(f"avg({x}) as {x}" for x in columns)} from near{s} group by cluster)""")
    return f"""with base as ({base}),
    c0 as (select (row_number() over (order by id) - 1)::int as cluster, {", ".join(columns)} from base qualify cluster < {k}), {",".join(level)}
    select cluster, count(*) as size, {r("(select sum(far) from near" + str(steps) + ")", 2)} as inertia from near{steps} group by cluster"""


@query(
    "kmeans_steps",
    _lloyd_sql(
        "select c_custkey as id, c_acctbal::double as c_acctbal, c_nationkey::double * 300 as c_place from customer",
        ["c_acctbal", "c_place"],
        4,
        3,
    ),
)
def kmeans_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Three k-means steps from given centres."""
    df = table(spark, sf, "customer").withColumn("c_place", F.col("c_nationkey").cast("double") * 300)
    first = df.orderBy("c_custkey").limit(4).select("c_acctbal", "c_place").collect()
    inputs, start = ["c_acctbal", "c_place"], np.array([[float(v) for v in row] for row in first])
    vectors = VectorAssembler(inputCols=inputs, outputCol="features").transform(df)
    found = fit_kmeans(numbered(vectors), 4, max_iter=3, tol=0.0, init=start)
    model = L.Model("kmeans", inputs, None, {}, extra={"centres": found.centres.tolist(), "inertia": found.inertia})
    sizes = model.score(df).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    return sizes.withColumn("inertia", F.round(F.lit(model.extra["inertia"]), 2))


_WARD_SQL = f"""
with recursive points as (
  select c_nationkey as id, floor(avg(c_acctbal)) as x from customer group by c_nationkey),
walk as (
  select list({{'m': [id], 'n': 1.0::double, 's': x::double}} order by id) as g from points
  union all
  select list_append(list_filter(g, lambda c, i: i <> best.a and i <> best.b),
    {{'m': list_concat(g[best.a].m, g[best.b].m), 'n': g[best.a].n + g[best.b].n, 's': g[best.a].s + g[best.b].s}}) as g
  from (
    select g, list_sort(flatten(list_transform(range(1, len(g)), lambda i: list_transform(range(i + 1, len(g) + 1), lambda j:
      {{'cost': g[i].n * g[j].n / (g[i].n + g[j].n) * pow(g[i].s / g[i].n - g[j].s / g[j].n, 2), 'a': i, 'b': j}}))))[1] as best
    from walk where len(g) > 4)),
done as (select unnest(g) as c from walk where len(g) = 4)
select list_min(c.m)::int as first_nation, len(c.m) as size, {r("c.s / c.n")} as centre from done"""


@query("ward_nations", _WARD_SQL)
def ward_nations(spark: SparkSession, sf: str) -> DataFrame:
    """Four groups of nations by their customers' mean balance, merged by Ward's cost."""
    mean = F.floor(F.avg("c_acctbal")).cast("double").alias("x")
    df = table(spark, sf, "customer").groupBy("c_nationkey").agg(mean)
    scored = L.fit(df, "hierarchical_clustering", ["x"], parameters={"n_clusters": 4}).score(df)
    found = scored.groupBy("prediction").agg(
        F.min("c_nationkey").alias("first_nation"), F.count(F.lit(1)).alias("size"), F.avg("x").alias("centre")
    )
    return tidy(found.drop("prediction"))


_LEAVES = [1, 1500, 100000]


@query(
    "grid_stumps",
    f"""with long as ({" union all ".join(f"select l_quantity as y, '{c}' as feature, {c}::double as value from lineitem" for c in ["l_discount", "l_tax", "l_linenumber"])}),
    counts as (select feature, value, count(*) as m, sum(y) as s from long group by feature, value),
    run as (select *, sum(m) over w as lm, sum(s) over w as ls, sum(m) over (partition by feature) as tm, sum(s) over (partition by feature) as ts
      from counts window w as (partition by feature order by value)),
    whole as (select count(*) as n, sum(l_quantity) as s, sum(l_quantity * l_quantity) as q from lineitem),
    best as (
      select leaf, max(ls * ls / lm + (ts - ls) * (ts - ls) / nullif(tm - lm, 0)) filter (where lm >= leaf and tm - lm >= leaf) as worth
      from run, (values {", ".join(f"({v})" for v in _LEAVES)}) t(leaf) group by leaf)
    select leaf::int as min_samples_leaf, {r("(q - coalesce(worth, s * s / n)) / n")} as mse from best, whole""",
)
def grid_stumps(spark: SparkSession, sf: str) -> DataFrame:
    """A search over trees of depth 1; every trial's error."""
    df, inputs = table(spark, sf, "lineitem"), ["l_discount", "l_tax", "l_linenumber"]
    grid = {"max_depth": [1], "min_samples_leaf": _LEAVES}
    found = T.grid_search(df.select("l_quantity", *inputs), "decision_tree_regressor", inputs, "l_quantity", grid, df)
    leaf = F.get_json_object("parameters", "$.min_samples_leaf").cast("int")
    return tidy(found.filter("metric = 'mse'").select(leaf.alias("min_samples_leaf"), F.col("value").alias("mse")))


@query(
    "registry_jobs",
    """select event_id::varchar as id, c_custkey::varchar as model_id, event_type as status, c_name as model_name, c_mktsegment as algorithm
    from events join customer on user_id = c_custkey""",
)
def registry_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs with the models they train; jobs of unknown models are left out."""
    jobs = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("model_id"), F.col("event_type").alias("status")
    )
    models = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("algorithm")
    )
    return registry.jobs_with_models(jobs, models)
