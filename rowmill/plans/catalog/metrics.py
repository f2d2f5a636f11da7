"""Metric queries over rule-made predictions and labelled vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.operators import classification as C
from rowmill.operators import clustering as K
from rowmill.operators import distribution as D
from rowmill.operators import regression as R
from rowmill.plans.catalog.base import CLASS_PRED, REG_PRED, class_pred, query, r, reg_pred, table, tidy

_MARGINS = f"""{CLASS_PRED}, m as (
  select class, cast(sum(tp) as bigint) as tp, cast(sum(s) as bigint) as support, cast(sum(g) as bigint) as guessed from (
    select actual as class, (actual = predicted)::int as tp, 1 as s, 0 as g from class_pred
    union all select predicted, 0, 0, 1 from class_pred) group by class),
p as (select *, case when guessed > 0 then tp / guessed else 0 end as precision,
  case when support > 0 then tp / support else 0 end as recall,
  case when support + guessed > 0 then 2 * tp / (support + guessed) else 0 end as f1 from m)"""


@query(
    "confusion",
    f"""with {CLASS_PRED}, k as (select actual as c from class_pred union select predicted from class_pred)
    select a.c as actual, b.c as predicted, count(class_pred.actual) as n from k a join k b on true
    left join class_pred on class_pred.actual = a.c and class_pred.predicted = b.c group by 1, 2""",
)
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return C.confusion_matrix(class_pred(spark, sf), "actual", "predicted")


@query(
    "class_union",
    f"""with {CLASS_PRED} select actual as class from class_pred union select predicted from class_pred""",
)
def class_union(spark: SparkSession, sf: str) -> DataFrame:
    return C.classes(class_pred(spark, sf), "actual", "predicted")


@query(
    "per_class_metrics",
    f"with {_MARGINS} select class, {r('precision')} as precision, {r('recall')} as recall, {r('f1')} as f1, support from p",
)
def per_class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(C.per_class(class_pred(spark, sf), "actual", "predicted"))


@query(
    "class_metrics",
    f"""with {_MARGINS}, t as (select sum(support)::double as s, sum(tp)::double as c, sum(support::double * guessed) as tg,
      sum(support::double * support) as tt, sum(guessed::double * guessed) as gg from p)
    select (select count(*) from p) as n_classes, {r("c / s")} as accuracy,
      {r("(select sum(precision * support) from p) / s")} as precision, {r("(select sum(recall * support) from p) / s")} as recall,
      {r("(select sum(f1 * support) from p) / s")} as f1,
      {r("(select avg(recall) from p where support > 0)")} as balanced_accuracy,
      {r("(c / s - tg / (s * s)) / (1 - tg / (s * s))")} as cohen_kappa,
      {r("(c * s - tg) / sqrt((s * s - gg) * (s * s - tt))")} as matthews_corrcoef from t""",
)
def class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(C.class_metrics(class_pred(spark, sf), "actual", "predicted"))


@query(
    "class_report",
    f"""with {_MARGINS}, n as (select sum(support) as s from p)
    select class, {r("precision")} as precision, {r("recall")} as recall, {r("f1")} as f1, support from p
    union all select 'macro avg', {r("avg(precision)")}, {r("avg(recall)")}, {r("avg(f1)")}, cast(sum(support) as bigint) from p
    union all select 'weighted avg', {r("sum(precision * support) / sum(support)")}, {r("sum(recall * support) / sum(support)")},
      {r("sum(f1 * support) / sum(support)")}, cast(sum(support) as bigint) from p
    union all select 'accuracy', {r("sum(tp) / sum(support)")}, {r("sum(tp) / sum(support)")}, {r("sum(tp) / sum(support)")},
      cast(sum(support) as bigint) from p""",
)
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(C.classification_report(class_pred(spark, sf), "actual", "predicted"))


_STEPS = f"""{CLASS_PRED}, g as (select score, sum(positive::int) as pos, sum(1 - positive::int) as neg from class_pred group by score),
w as (select *, sum(pos) over (order by score desc) as tps, sum(neg) over (order by score desc) as fps,
  sum(pos) over () as tp_all, sum(neg) over () as fp_all from g)"""


@query("roc_points", f"with {_STEPS} select score, {r('fps / fp_all')} as fpr, {r('tps / tp_all')} as tpr from w")
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(C.roc_points(class_pred(spark, sf), F.col("positive"), F.col("score")))


@query("roc_auc", f"with {_STEPS} select {r('sum(neg * (2 * tps - pos) / 2.0) / (max(tps) * max(fps))')} as roc_auc from w")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(C.roc_auc(class_pred(spark, sf), F.col("positive"), F.col("score")).select("roc_auc"))


@query(
    "pr_points",
    f"""with {_STEPS} select score, {r("tps / (tps + fps)")} as precision, {r("tps / tp_all")} as recall from w
    union all select null, 1.0, 0.0""",
)
def pr_points(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(C.pr_points(class_pred(spark, sf), F.col("positive"), F.col("score")))


@query(
    "pr_auc",
    f"""with {_STEPS}, c as (select score, tps / (tps + fps) as p, tps / tp_all as rec from w union all select 1e9, 1.0, 0.0),
    l as (select p, rec, lag(p) over (order by score desc) as pp, lag(rec) over (order by score desc) as pr from c)
    select {r("sum((rec - pr) * (p + pp) / 2)")} as pr_auc from l""",
)
def pr_auc(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(C.pr_auc(class_pred(spark, sf), F.col("positive"), F.col("score")))


@query(
    "auc_ovr",
    f"""with {CLASS_PRED}, e as (
      select 'A' as class, actual = 'A' as y, score_a as s from class_pred union all
      select 'N', actual = 'N', score_n from class_pred union all select 'R', actual = 'R', score_r from class_pred),
    g as (select class, s, sum(y::int) as pos, sum(1 - y::int) as neg from e group by class, s),
    w as (select *, sum(pos) over (partition by class order by s desc) as tps,
      sum(neg) over (partition by class order by s desc) as fps from g),
    a as (select class, sum(neg * (2 * tps - pos) / 2.0) / (max(tps) * max(fps)) as auc, max(tps) as n from w group by class)
    select {r("avg(auc)")} as roc_auc_macro, {r("sum(auc * n) / sum(n)")} as roc_auc_weighted from a""",
)
def auc_ovr(spark: SparkSession, sf: str) -> DataFrame:
    scores = {"A": F.col("score_a"), "N": F.col("score_n"), "R": F.col("score_r")}
    return tidy(C.roc_auc_ovr(class_pred(spark, sf), "actual", scores))


def _reg_sql(y: str) -> str:
    e = f"({y} - predicted)"
    return f"""with {REG_PRED} select {r(f"1 - avg({e} * {e}) / var_pop({y})")} as r2_score, {r(f"avg({e} * {e})", 0)} as mse,
      {r(f"sqrt(avg({e} * {e}))")} as rmse, {r(f"avg(abs{e})")} as mae, {r(f"quantile_cont(abs{e}, 0.5)")} as median_ae,
      {r(f"1 - var_pop({e}) / var_pop({y})")} as explained_variance, {r(f"max(abs{e})")} as max_error,
      {r(f"case when min(abs({y})) > 0 then avg(abs({e} / nullif({y}, 0))) * 100 end")} as mape,
      {r(f"corr({y}, predicted)")} as pred_actual_correlation from reg_pred"""


@query("reg_metrics", _reg_sql("actual"))
def reg_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = R.regression_metrics(reg_pred(spark, sf), "actual", "predicted")
    return tidy(found.withColumn("mse", F.round("mse", 0)))


_E0 = "(actual_zero - predicted)"


@query(
    "reg_metrics_zero",
    f"""with {REG_PRED} select {r(f"avg(abs{_E0})")} as mae, {r(f"sqrt(avg({_E0} * {_E0}))")} as rmse,
      {r("case when min(abs(actual_zero)) > 0 then 0.0 end")} as mape from reg_pred""",
)
def reg_metrics_zero(spark: SparkSession, sf: str) -> DataFrame:
    """Zero actuals: the percentage error is empty."""
    return tidy(R.regression_metrics(reg_pred(spark, sf), "actual_zero", "predicted").select("mae", "rmse", "mape"))


@query(
    "residual_stats",
    f"""with {REG_PRED} select {r("avg(actual - predicted)")} as mean, {r("stddev_pop(actual - predicted)")} as std,
      {r("min(actual - predicted)")} as min, {r("max(actual - predicted)")} as max,
      {r("quantile_cont(actual - predicted, 0.25)")} as q25, {r("quantile_cont(actual - predicted, 0.75)")} as q75 from reg_pred""",
)
def residual_stats(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(R.residual_stats(reg_pred(spark, sf), "actual", "predicted"))


@query(
    "prediction_moments",
    f"with {REG_PRED} "
    + " union all ".join(
        f"""select '{c}' as "column", {r(f"avg({c})")} as mean, {r(f"stddev_pop({c})")} as std, {r(f"min({c})")} as min,
        {r(f"max({c})")} as max from reg_pred"""
        for c in ("actual", "predicted")
    ),
)
def prediction_moments(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(R.moments(reg_pred(spark, sf), ["actual", "predicted"]))


@query(
    "dist_numeric",
    f"with {REG_PRED} "
    + " union all ".join(
        f"""select '{c}' as "column", {r(f"avg({c})")} as mean, {r(f"stddev_pop({c})")} as std, {r(f"min({c})")} as min,
        {r(f"max({c})")} as max, {", ".join(r(f"quantile_cont({c}, {p})") + f" as {k}" for k, p in D.PERCENTILES.items())} from reg_pred"""
        for c in ("actual", "predicted")
    ),
)
def dist_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(D.numeric_distribution(reg_pred(spark, sf), ["actual", "predicted"]))


@query(
    "dist_categorical",
    f"""with {CLASS_PRED}, vc as (select 'actual' as c, actual as v, count(*) as n from class_pred group by actual
      union all select 'predicted', predicted, count(*) from class_pred group by predicted),
    k as (select *, row_number() over (partition by c order by n desc, v) as top,
      row_number() over (partition by c order by n, v) as low from vc)
    select c as "column", count(*) as unique_count, max(case when top = 1 then v end) as most_frequent, max(n) as most_count,
      max(case when low = 1 then v end) as least_frequent, min(n) as least_count from k group by c""",
)
def dist_categorical(spark: SparkSession, sf: str) -> DataFrame:
    return D.categorical_distribution(class_pred(spark, sf), ["actual", "predicted"])


@query(
    "prediction_uncertainty",
    f"""with {REG_PRED}, s as (select stddev_pop(predicted) as s from reg_pred union all select stddev_pop(actual) from reg_pred)
    select {r("avg(s)")} as mean_std, {r("max(s)")} as max_std from s""",
)
def prediction_uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(D.prediction_uncertainty(reg_pred(spark, sf), ["predicted", "actual"]))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return K.as_points(table(spark, sf, "embeddings"), "vec_id", "label", "embedding")


_LONG = """e as (select vec_id, label, generate_subscripts(embedding, 1) - 1 as f, unnest(embedding)::double as x from embeddings),
s as (select label as cluster, f as feature, count(*) as size, avg(x) as m, var_pop(x) as v from e group by 1, 2)"""


@query("cluster_sizes", "select label as cluster, count(*) as size from embeddings group by label")
def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return K.cluster_sizes(table(spark, sf, "embeddings"), "label")


@query(
    "cluster_analysis",
    f"with {_LONG} select cluster, feature::int as feature, size, {r('m')} as centroid, {r('sqrt(v)')} as std from s",
)
def cluster_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(K.cluster_analysis(_points(spark, sf)))


@query(
    "calinski_harabasz",
    f"""with {_LONG}, g as (select feature, sum(size * m) / sum(size) as g from s group by feature),
    d as (select sum(size * (m - g) * (m - g)) as b, sum(size * v) as w from s join g using (feature)),
    n as (select count(*) as n, count(distinct label) as k from embeddings)
    select {r("(b / (k - 1)) / (w / (n - k))")} as calinski_harabasz from d, n""",
)
def calinski_harabasz(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(K.calinski_harabasz(_points(spark, sf)))


@query(
    "davies_bouldin",
    f"""with {_LONG}, p as (select vec_id, cluster, sqrt(sum((x - m) * (x - m))) as d from e
      join s on e.label = s.cluster and e.f = s.feature group by 1, 2),
    sc as (select cluster, avg(d) as s from p group by 1),
    cd as (select a.cluster as i, b.cluster as j, sqrt(sum((a.m - b.m) * (a.m - b.m))) as d from s a join s b
      on a.feature = b.feature and a.cluster <> b.cluster group by 1, 2),
    w as (select i, max((x.s + y.s) / d) as w from cd join sc x on x.cluster = i join sc y on y.cluster = j group by i)
    select {r("avg(w)")} as davies_bouldin from w""",
)
def davies_bouldin(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(K.davies_bouldin(_points(spark, sf)))


def _silhouette_sql(distance: str) -> str:
    return f"""d as (select a.vec_id, a.label as mine, b.label as other,
      sum({distance}) as t, count(*) as n from v a join v b on true group by 1, 2, 3),
    s as (select vec_id, mine, max(case when other = mine then t / greatest(n - 1, 1) end) as a,
      max(case when other = mine then n end) as n, min(case when other <> mine then t / n end) as b from d group by 1, 2)"""


_VECTORS = "v as (select vec_id, label, embedding::double[] as x from embeddings)"


@query(
    "silhouette_exact",
    f"""with {_VECTORS}, {_silhouette_sql("list_distance(a.x, b.x)")}
    select {r("avg(case when n > 1 then (b - a) / greatest(a, b) else 0 end)")} as silhouette from s""",
)
def silhouette_exact(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(K.silhouette(_points(spark, sf)))


@query(
    "silhouette_sampled",
    f"""with {_VECTORS}, {_silhouette_sql("list_distance(a.x, b.x)")}
    select {r("avg(case when n > 1 then (b - a) / greatest(a, b) else 0 end)")} as silhouette, 0.0 as silhouette_error,
      (select count(distinct label) from embeddings) as n_clusters from s""",
)
def silhouette_sampled(spark: SparkSession, sf: str) -> DataFrame:
    """As many points are drawn as there are vectors up to sf0.1, so the estimate is exact."""
    return tidy(K.silhouette_sampled(_points(spark, sf)))


@query(
    "silhouette_squared",
    f"""with {_VECTORS}, {_silhouette_sql("pow(list_distance(a.x, b.x), 2)")}
    select {r("avg(case when n > 1 then (b - a) / greatest(a, b) else 0 end)")} as silhouette_squared from s""",
)
def silhouette_squared(spark: SparkSession, sf: str) -> DataFrame:
    value = K.silhouette_squared(_points(spark, sf))
    return tidy(spark.createDataFrame([(value,)], "silhouette_squared double"))
