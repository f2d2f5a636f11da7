"""Learning queries.

Solvers that are exact have a closed form in SQL; the others are checked by
their rows here and by invariants in the tests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.functions.storage import checkpoint_folder, settle
from rowmill.operators import learn as L
from rowmill.operators.split import with_split
from rowmill.plans import training as T
from rowmill.plans.catalog.base import MEASURES, query, r, table, tidy

_INPUTS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


@query(
    "linreg",
    f"""select {r("regr_slope(l_extendedprice, l_quantity)")} as slope, {r("regr_intercept(l_extendedprice, l_quantity)")} as intercept
    from lineitem""",
)
def linreg(spark: SparkSession, sf: str) -> DataFrame:
    model = L.fit(_lines(spark, sf), "linear_regression", ["l_quantity"], "l_extendedprice")
    fitted = model.stages.stages[-1]
    row = (float(fitted.coefficients[0]), float(fitted.intercept))
    return tidy(spark.createDataFrame([row], "slope double, intercept double"))


@query(
    "linreg_score",
    f"""with m as (select regr_slope(l_extendedprice, l_quantity) as a, regr_intercept(l_extendedprice, l_quantity) as b from lineitem)
    select l_orderkey, l_linenumber, {r("a * l_quantity + b", 2)} as prediction from lineitem, m""",
)
def linreg_score(spark: SparkSession, sf: str) -> DataFrame:
    df = _lines(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    model = L.fit(df, "linear_regression", ["l_quantity"], "l_extendedprice")
    scored = model.score(df).select("l_orderkey", "l_linenumber", "prediction")
    return tidy(scored, 2)


@query(
    "linreg_metrics",
    f"""select {r("regr_r2(l_extendedprice, l_quantity)")} as value, 'r2_score' as metric from lineitem""",
)
def linreg_metrics(spark: SparkSession, sf: str) -> DataFrame:
    df = _lines(spark, sf).select("l_quantity", "l_extendedprice")
    model = L.fit(df, "linear_regression", ["l_quantity"], "l_extendedprice")
    return tidy(T.evaluate(model, df).filter("metric = 'r2_score'").select("metric", "value"))


@query(
    "pca_ratio",
    f"""with c as (select var_samp(l_quantity) as a, var_samp(l_linenumber) as d, covar_samp(l_quantity, l_linenumber) as b from lineitem),
    e as (select (a + d) / 2 as h, sqrt((a - d) * (a - d) / 4 + b * b) as s from c)
    select 1 as component, {r("(h + s) / (2 * h)")} as ratio, {r("(h + s) / (2 * h)")} as cumulative from e
    union all select 2, {r("(h - s) / (2 * h)")}, 1.0 from e""",
)
def pca_ratio(spark: SparkSession, sf: str) -> DataFrame:
    model = L.fit(_lines(spark, sf), "pca", ["l_quantity", "l_linenumber"])
    return tidy(L.explained_variance(spark, model))


@query(
    "pca_scores",
    f"""with c as (select avg(l_quantity) as mx, avg(l_linenumber) as my, var_samp(l_quantity) as a, var_samp(l_linenumber) as d,
      covar_samp(l_quantity, l_linenumber) as b from lineitem),
    t as (select *, 0.5 * atan2(2 * b, a - d) as t from c)
    select l_orderkey, l_linenumber, {r("cos(t) * (l_quantity - mx) + sin(t) * (l_linenumber - my)")} as first from lineitem, t""",
)
def pca_scores(spark: SparkSession, sf: str) -> DataFrame:
    df = _lines(spark, sf).select("l_orderkey", "l_quantity", "l_linenumber")
    scored = L.fit(df, "pca", ["l_quantity", "l_linenumber"]).score(df)
    return tidy(scored.select("l_orderkey", "l_linenumber", F.col("components")[0].alias("first")))


#: Steps of the power iteration in SQL.
_POWER = 600


@query(
    "pca_wide",
    f"""with recursive e as (select embedding::double[] as x from embeddings where len(embedding) = 64),
    c as (select i, j, covar_samp(x[i], x[j]) as c from e, range(1, 65) a(i), range(1, 65) b(j) group by i, j),
    g as (select i, list(c order by j) as g from c group by i),
    m as (select list(g order by i) as m, sum(g[i]) as total from g),
    p(k, v) as (select 0, list_transform(range(64), lambda z: (z % 7 - 2.9)::double) union all
      select k + 1, list_transform(w, lambda z: z / sqrt(list_dot_product(w, w)))
      from (select k, list_transform(m, lambda z: list_dot_product(z, v)) as w from p, m where k < {_POWER})),
    one as (select v as v1, sqrt(list_dot_product(u, u)) as l1
      from (select v, list_transform(m, lambda z: list_dot_product(z, v)) as u from p, m where k = {_POWER})),
    q(k, v) as (select 0, list_transform(range(64), lambda z: (z % 5 - 1.7)::double) union all
      select k + 1, list_transform(w, lambda z: z / sqrt(list_dot_product(w, w))) from (
        select k, list_transform(range(1, 65), lambda z: list_dot_product(m[z], v) - l1 * list_dot_product(v1, v) * v1[z]) as w
        from q, m, one where k < {_POWER})),
    two as (select sqrt(list_dot_product(u, u)) as l2
      from (select list_transform(m, lambda z: list_dot_product(z, v)) as u from q, m where k = {_POWER}))
    select 1 as component, {r("l1 / total")} as ratio, {r("l1 / total")} as cumulative from one, m
    union all select 2, {r("l2 / total")}, {r("(l1 + l2) / total")} from one, two, m""",
)
def pca_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the embeddings without a square matrix."""
    rows = table(spark, sf, "embeddings").filter(F.size("embedding") == 64)
    model = L.fit(rows, "pca", ["embedding"], parameters={"svd_solver": "randomized"})
    return tidy(L.explained_variance(spark, model))


_RECOMMEND = [("classification", "orders"), ("regression", "lineitem"), ("clustering", "customer"), ("classification", "supplier")]


@query(
    "recommend_algo",
    """with n as (select 'classification' as problem, 'orders' as source, count(*) as n from orders
      union all select 'regression', 'lineitem', count(*) from lineitem
      union all select 'clustering', 'customer', count(*) from customer
      union all select 'classification', 'supplier', count(*) from supplier),
    a as (select *, case problem
      when 'classification' then case when n < 1000 then ['logistic_regression', 'decision_tree_classifier']
        when n < 10000 then ['random_forest_classifier', 'svm_classifier']
        else ['random_forest_classifier', 'neural_network_classifier'] end
      when 'regression' then case when n < 1000 then ['linear_regression', 'decision_tree_regressor']
        when n < 10000 then ['random_forest_regressor', 'svm_regressor']
        else ['random_forest_regressor', 'neural_network_regressor'] end
      else case when n < 5000 then ['kmeans', 'hierarchical_clustering'] else ['kmeans'] end end as l from n)
    select problem, source, (generate_subscripts(l, 1) - 1)::int as position, unnest(l) as algorithm from a""",
)
def recommend_algo(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for problem, source in _RECOMMEND:
        found = L.recommend_algorithms(table(spark, sf, source), problem)
        rows = found.select(F.lit(problem).alias("problem"), F.lit(source).alias("source"), "position", "algorithm")
        out = rows if out is None else out.unionByName(rows)
    return out


def _orders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders with a price rule as class and numeric inputs, split by key."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        (F.col("o_totalprice") / 1e5).alias("price"),
        (F.col("c_acctbal") / 1e3).alias("balance"),
        F.month("o_orderdate").cast("double").alias("month"),
    )
    score = F.col("price") + F.col("balance") / 4 + F.col("month") / 6
    named = joined.withColumn("tier", F.when(score < 4, "low").when(score < 5.5, "mid").otherwise("high")).withColumn(
        "worth", score * 10
    )
    split = settle(with_split(named, "o_orderkey", "tier"))
    return split.filter("split = 'train'").drop("split"), split.filter("split = 'test'").drop("split")


_ORDER_INPUTS = ["price", "balance", "month"]


def _supervised(algorithm: str, target: str, parameters: dict | None = None):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        train, test = _orders(spark, sf)
        model = L.fit(train, algorithm, _ORDER_INPUTS, target, parameters)
        return tidy(T.evaluate(model, test))

    return run


for _name, _algorithm, _parameters in [
    ("logreg", "logistic_regression", None),
    ("tree_classifier", "decision_tree_classifier", None),
    ("forest_classifier", "random_forest_classifier", None),
    ("svm_clf", "svm_classifier", None),
    ("mlp_clf", "neural_network_classifier", None),
]:
    query(_name)(_supervised(_algorithm, "tier", _parameters))
for _name, _algorithm, _parameters in [
    ("tree_regressor", "decision_tree_regressor", None),
    ("forest_regressor", "random_forest_regressor", None),
    ("svr", "svm_regressor", None),
    ("mlp_reg", "neural_network_regressor", None),
]:
    query(_name)(_supervised(_algorithm, "worth", _parameters))


@query("dense_network")
def dense_network(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _orders(spark, sf)
    return tidy(T.evaluate(L.fit_dense_network(train, _ORDER_INPUTS, "tier"), test))


@query("importance")
def importance(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _orders(spark, sf)
    return tidy(L.fit(train, "decision_tree_regressor", _ORDER_INPUTS, "worth").importances(spark))


@query("kmeans")
def kmeans(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster sizes and the inertia of the best of ten restarts."""
    df = _lines(spark, sf).select("l_orderkey", *MEASURES)
    model = L.fit(df, "kmeans", ["l_quantity", "l_discount", "l_tax"])
    sizes = model.score(df).groupBy("prediction").agg(F.count(F.lit(1)).alias("size"))
    return tidy(sizes.withColumn("inertia", F.lit(model.extra["inertia"])))


@query("hierarchical")
def hierarchical(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "embeddings")
    model = L.fit(df, "hierarchical_clustering", ["embedding"], parameters={"n_clusters": 10})
    return model.score(df).groupBy("prediction").agg(F.count(F.lit(1)).alias("size"))


@query("bisecting")
def bisecting(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "embeddings")
    model = L.fit(df, "hierarchical_clustering", ["embedding"], parameters={"n_clusters": 10, "linkage": "top_down"})
    return model.score(df).groupBy("prediction").agg(F.count(F.lit(1)).alias("size"))


@query(
    "batch_score",
    f"""with m as (select regr_slope(l_extendedprice, l_quantity) as a, regr_intercept(l_extendedprice, l_quantity) as b from lineitem)
    select l_orderkey, l_linenumber, {r("a * l_quantity + b", 2)} as from_array, {r("a * l_quantity + b", 2)} as from_record
    from lineitem, m""",
)
def batch_score(spark: SparkSession, sf: str) -> DataFrame:
    """A saved and reloaded model scoring arrays and named records."""
    df = _lines(spark, sf)
    path = f"{checkpoint_folder(spark)}/models/{uuid.uuid4().hex}"
    L.fit(df, "linear_regression", ["l_quantity"], "l_extendedprice").save(spark, path, {"source": "lineitem"})
    model, _ = L.Model.load(spark, path)
    keys = ["l_orderkey", "l_linenumber"]
    arrays = L.score_arrays(model, df.select(*keys, F.array("l_quantity").alias("x")), "x", keys)
    named = arrays.withColumnRenamed("prediction", "from_array")
    both = L.score_records(model, named, [*keys, "from_array"])
    return tidy(both.select(*keys, "from_array", F.col("prediction").alias("from_record")), 2)


@query("compare_models")
def compare_models(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _orders(spark, sf)
    models = {
        "line": L.fit(train, "linear_regression", _ORDER_INPUTS, "worth"),
        "tree": L.fit(train, "decision_tree_regressor", _ORDER_INPUTS, "worth"),
        "price_only": L.fit(train, "linear_regression", ["price"], "worth"),
    }
    ranking, _ = T.compare(models, test)
    return tidy(ranking)


@query("grid_search")
def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _orders(spark, sf)
    grid = {"max_depth": [2, 4, 6], "min_samples_leaf": [1, 10]}
    return tidy(T.grid_search(train, "decision_tree_regressor", _ORDER_INPUTS, "worth", grid, test))


@query("train_job")
def train_job(spark: SparkSession, sf: str) -> DataFrame:
    """Preparation fitted on the training rows, then fit and evaluation."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    config = {"algorithm": "logistic_regression", "target_column": "o_orderstatus"}
    return tidy(T.train_table(df, config, "o_orderkey").metrics)
