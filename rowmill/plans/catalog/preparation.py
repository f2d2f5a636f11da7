"""Preparation queries: filling, filters, features, encoders, scaling, selection, split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.operators import missing as M
from rowmill.operators import profile as P
from rowmill.operators import select as S
from rowmill.operators.encode import fit_encode
from rowmill.operators.features import fit_features, fit_squares
from rowmill.operators.outliers import fit_outliers
from rowmill.operators.scale import fit_scale
from rowmill.operators.split import split_summary, with_split
from rowmill.operators.steps import Chain, align_features
from rowmill.plans.catalog.base import GAPS, MEASURES, gaps, query, r, table, tidy
from rowmill.plans.prepare import prepare, prepare_basic

LINE = ["l_orderkey", "l_linenumber"]


def _mode(column: str) -> str:
    return (
        f"(select {column} from gaps where {column} is not null group by {column} "
        f"order by count(*) desc, {column} limit 1)"
    )


@query(
    "impute_auto",
    f"""with {GAPS}, f as (select avg(g_mean) as a, quantile_cont(g_median, 0.5) as b, avg(g_knn) as c from gaps)
    select o_orderkey, {r("coalesce(g_mean, a)")} as g_mean, {r("coalesce(g_median, b)")} as g_median,
      {r("coalesce(g_knn, c)")} as g_knn, coalesce(g_cat, {_mode("g_cat")}) as g_cat from gaps, f""",
)
def impute_auto(spark: SparkSession, sf: str) -> DataFrame:
    df = gaps(spark, sf).select("o_orderkey", "g_mean", "g_median", "g_knn", "g_cat")
    return tidy(M.fit_impute(df, "auto", protect=["o_orderkey"]).transform(df))


def _fixed(strategy: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = gaps(spark, sf).select("o_orderkey", "g_mean", "g_knn")
        return tidy(M.fit_impute(df, strategy, protect=["o_orderkey"]).transform(df))

    return run


_FILLS = {
    "impute_mean": ("mean", "avg({c})"),
    "impute_median": ("median", "quantile_cont({c}, 0.5)"),
    "impute_zero": ("constant", "max(0.0)"),
}
for _name, (_strategy, _sql) in _FILLS.items():
    query(
        _name,
        f"""with {GAPS}, f as (select {_sql.format(c="g_mean")} as a, {_sql.format(c="g_knn")} as b from gaps)
        select o_orderkey, {r("coalesce(g_mean, a)")} as g_mean, {r("coalesce(g_knn, b)")} as g_knn from gaps, f""",
    )(_fixed(_strategy))


@query(
    "impute_mode",
    f"""with {GAPS} select o_orderkey, coalesce(g_cat, {_mode("g_cat")}) as g_cat, 'Unknown' as g_none from gaps""",
)
def impute_mode(spark: SparkSession, sf: str) -> DataFrame:
    df = gaps(spark, sf).select("o_orderkey", "g_cat", F.lit(None).cast("string").alias("g_none"))
    return M.fit_impute(df, "mean", protect=["o_orderkey"]).transform(df)


_SPARSE = ["o_totalprice", "g_mean", "g_median", "g_knn", "g_drop", "g_cat"]


@query(
    "drop_sparse",
    f"with {GAPS} "
    + "\nunion all\n".join(
        f"""select '{c}' as "column", count(*) - count({c}) as missing from gaps having (count(*) - count({c})) / count(*) <= 0.5"""
        for c in _SPARSE
    ),
)
def drop_sparse(spark: SparkSession, sf: str) -> DataFrame:
    df = gaps(spark, sf).select(*_SPARSE)
    return P.missing_report(M.fit_drop_sparse(df, 0.5).transform(df)).select("column", "missing")


@query("target_present", f"with {GAPS} select o_orderkey, g_cat from gaps where g_cat is not null")
def target_present(spark: SparkSession, sf: str) -> DataFrame:
    return M.drop_missing_target(gaps(spark, sf).select("o_orderkey", "g_cat"), "g_cat")


@query("dedupe", "select md5(text) as text_md5, lang from (select distinct text, lang from documents)")
def dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("text", "lang").dropDuplicates()
    return rows.select(F.md5("text").alias("text_md5"), "lang")


def _iqr_sql(source: str, columns: list[str], keep: str) -> str:
    parts, prev = [], source
    for i, c in enumerate(columns):
        parts.append(
            f"s{i} as (select t.* from {prev} t, (select quantile_cont(cast({c} as double), [0.25, 0.75]) as q from {prev}) "
            f"where {c} >= q[1] - 1.5 * (q[2] - q[1]) and {c} <= q[2] + 1.5 * (q[2] - q[1]))"
        )
        prev = f"s{i}"
    return f"with {', '.join(parts)} select {keep} from {prev}"


_LINE_KEEP = "l_orderkey, l_linenumber, " + ", ".join(f"{r(c)} as {c}" for c in MEASURES)


@query("iqr_filter", _iqr_sql("lineitem", MEASURES, _LINE_KEEP))
def iqr_filter(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select(*LINE, *MEASURES)
    return tidy(fit_outliers(df, "iqr", 1.5, MEASURES).transform(df))


@query("iqr_filter_events", _iqr_sql("events", ["event_id", "user_id", "value"], f"event_id, user_id, {r('value')} as value"))
def iqr_filter_events(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_id", "user_id", "value")
    return tidy(fit_outliers(df, "iqr").transform(df))


def _z_sql(columns: list[str]) -> str:
    parts, prev = [], "lineitem"
    for i, c in enumerate(columns):
        parts.append(
            f"s{i} as (select t.* from {prev} t, (select avg({c}) as m, stddev_samp({c}) as d from {prev}) "
            f"where abs({c} - m) / d <= 1.5)"
        )
        prev = f"s{i}"
    return f"with {', '.join(parts)} select {_LINE_KEEP} from {prev}"


@query("zscore_filter", _z_sql(MEASURES))
def zscore_filter(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select(*LINE, *MEASURES)
    return tidy(fit_outliers(df, "zscore", 1.5, MEASURES).transform(df))


def _bin_sql(c: str, bins: int) -> str:
    edges = " + ".join(f"({c} > lo_{c} + {i} * ((hi_{c} - lo_{c}) / {bins}.0))::int" for i in range(1, bins))
    return f"case when lo_{c} = hi_{c} then {(bins - 1) // 2} else {edges} end as {c}_binned"


_FEATURES = {
    "polynomial_features": True,
    "polynomial_degree": 3,
    "interaction_features": True,
    "log_transform": True,
    "binning": True,
    "n_bins": 5,
}


@query(
    "poly_interact_log_bin",
    f"""with s as (select min(p_size)::double as lo_p_size, max(p_size)::double as hi_p_size,
      min(p_retailprice) as lo_p_retailprice, max(p_retailprice) as hi_p_retailprice from part)
    select p_partkey, p_size, {r("p_retailprice")} as p_retailprice,
      {r("pow(p_size, 2)")} as p_size_poly_2, {r("pow(p_size, 3)")} as p_size_poly_3,
      {r("pow(p_retailprice, 2)", 2)} as p_retailprice_poly_2, {r("pow(p_retailprice, 3)", 0)} as p_retailprice_poly_3,
      {r("p_size * p_retailprice")} as p_size_x_p_retailprice,
      {r("ln(1 + p_size)")} as p_size_log, {r("ln(1 + p_retailprice)")} as p_retailprice_log,
      {_bin_sql("p_size", 5)}, {_bin_sql("p_retailprice", 5)}
    from part, s""",
)
def poly_interact_log_bin(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    made = fit_features(df, _FEATURES, protect=["p_partkey"]).transform(df)
    made = made.withColumn("p_retailprice_poly_2", F.round("p_retailprice_poly_2", 2)).withColumn(
        "p_retailprice_poly_3", F.round("p_retailprice_poly_3", 0)
    )
    return tidy(made)


@query(
    "interactions_bins_lineitem",
    f"""with s as (select {", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in MEASURES)}, from lineitem)
    select l_orderkey, l_linenumber, {", ".join(r(f"{a} * {b}") + f" as {a}_x_{b}" for i, a in enumerate(MEASURES) for b in MEASURES[i + 1:])},
      {", ".join(_bin_sql(c, 7) for c in MEASURES)} from lineitem, s""".replace(", from", " from"),
)
def interactions_bins_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select(*LINE, *MEASURES)
    config = {"interaction_features": True, "binning": True, "n_bins": 7}
    return tidy(fit_features(df, config, MEASURES).transform(df).drop(*MEASURES))


@query(
    "bins_constant",
    "select o_orderkey, 1 as flat_binned from orders",
)
def bins_constant(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").select("o_orderkey", F.lit(7.5).alias("flat"))
    return fit_features(df, {"binning": True, "n_bins": 4}, ["flat"]).transform(df).drop("flat")


@query(
    "squares",
    f"""select l_orderkey, l_linenumber, {r("l_quantity * l_quantity")} as l_quantity_squared,
      {r("pow(l_extendedprice, 2)", 1)} as l_extendedprice_squared, {r("pow(l_discount, 2)")} as l_discount_squared,
      {r("l_quantity * l_extendedprice")} as l_quantity_x_l_extendedprice from lineitem""",
)
def squares(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select(*LINE, *MEASURES)
    made = fit_squares(df, {"polynomial_features": True, "interaction_features": True}, LINE).transform(df)
    made = made.withColumn("l_extendedprice_squared", F.round("l_extendedprice_squared", 1))
    return tidy(made.drop(*MEASURES))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _hot(column: str, values: list[str]) -> str:
    return ", ".join(f"""coalesce({column} = '{v}', false)::int as "{column}_{v}" """ for v in values[1:])


@query(
    "onehot",
    f"""with {GAPS} select o_orderkey, {_hot("o_orderstatus", ["F", "O", "P"])}, {_hot("g_cat", _PRIORITIES)} from gaps""",
)
def onehot(spark: SparkSession, sf: str) -> DataFrame:
    df = gaps(spark, sf).select("o_orderkey", "o_orderstatus", "g_cat")
    return tidy(fit_encode(df, "onehot").transform(df))


@query(
    "label_encode",
    f"""with {GAPS}, codes as (select v, row_number() over (order by v) - 1 as code
      from (select distinct coalesce(g_cat, 'nan') as v from gaps))
    select o_orderkey, code as g_cat_encoded from gaps join codes on coalesce(g_cat, 'nan') = v""",
)
def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    df = gaps(spark, sf).select("o_orderkey", "g_cat")
    return fit_encode(df, "label").transform(df)


@query(
    "label_encode_part",
    "select p_partkey, "
    + ", ".join(f"dense_rank() over (order by {c}) - 1 as {c}_encoded" for c in ("p_name", "p_brand", "p_type"))
    + " from part",
)
def label_encode_part(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return fit_encode(df, "label").transform(df)


@query(
    "target_encode",
    f"""with {GAPS}, m as (select g_cat as v, avg(o_totalprice) as m from gaps where g_cat is not null group by 1)
    select o_orderkey, {r("o_totalprice")} as o_totalprice, {r("m")} as g_cat_target_encoded
    from gaps left join m on g_cat = v""",
)
def target_encode(spark: SparkSession, sf: str) -> DataFrame:
    df = gaps(spark, sf).select("o_orderkey", "o_totalprice", "g_cat")
    return tidy(fit_encode(df, "target", "o_totalprice").transform(df))


@query(
    "encode_auto",
    f"""select p_partkey, {r("p_retailprice")} as p_retailprice,
      {r("avg(p_retailprice) over (partition by p_name)")} as p_name_target_encoded,
      {r("avg(p_retailprice) over (partition by p_brand)")} as p_brand_target_encoded,
      {_hot("p_type", ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])} from part""",
)
def encode_auto(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_name", "p_brand", "p_type")
    return tidy(fit_encode(df, "auto", "p_retailprice").transform(df))


def _scaler(method: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, "lineitem").select(*LINE, *MEASURES, F.lit(3.0).alias("flat"))
        return tidy(fit_scale(df, method, [*MEASURES, "flat"]).transform(df))

    return run


_SCALERS = {
    "standard": ("avg({c})", "stddev_pop({c})"),
    "minmax": ("min({c})", "max({c}) - min({c})"),
    "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
}
for _method, (_centre, _spread) in _SCALERS.items():
    _params = ", ".join(f"{_centre.format(c=c)} as a_{c}, {_spread.format(c=c)} as b_{c}" for c in MEASURES)
    query(
        f"scale_{_method}",
        f"with s as (select {_params} from lineitem) select l_orderkey, l_linenumber, "
        + ", ".join(f"{r(f'({c} - a_{c}) / b_{c}')} as {c}" for c in MEASURES)
        + ", 0.0::double as flat from lineitem, s",
    )(_scaler(_method))


_SCORED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _scores(df: DataFrame, target: str, method: str) -> DataFrame:
    kept = S.fit_select(df, target, method, 2).state["columns"]
    scored = S.feature_scores(df, target, method)
    return tidy(scored.withColumn("selected", F.col("column").isin(kept)))


def _select_sql(rows: list[str]) -> str:
    return f"""with s as ({" union all ".join(rows)})
    select "column", {r("score")} as score, (row_number() over (order by score desc) <= 2)::int as selected from s"""


@query(
    "select_f_class",
    _select_sql(
        [
            f"""(select '{c}' as "column", (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) as score
            from (select count(*) as n, avg({c}) as m, var_pop({c}) as v from lineitem group by l_returnflag),
              (select avg({c}) as g from lineitem))"""
            for c in _SCORED
        ]
    ),
)
def select_f_class(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(table(spark, sf, "lineitem").select(*_SCORED, "l_returnflag"), "l_returnflag", "auto")


@query(
    "select_chi2",
    _select_sql(
        [
            f"""(select '{c}' as "column", sum((o - n / t * s) * (o - n / t * s) / (n / t * s)) as score
            from (select count(*) as n, sum({c}) as o from lineitem group by l_returnflag),
              (select count(*) as t, sum({c}) as s from lineitem))"""
            for c in _SCORED
        ]
    ),
)
def select_chi2(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(table(spark, sf, "lineitem").select(*_SCORED, "l_returnflag"), "l_returnflag", "chi2")


_REG_SCORED = [c for c in _SCORED if c != "l_extendedprice"]


@query(
    "select_f_reg",
    _select_sql(
        [
            f"""(select '{c}' as "column", c2 / (1 - c2) * (n - 2) as score from
            (select pow(corr({c}, l_extendedprice), 2) as c2, count(*) as n from lineitem))"""
            for c in _REG_SCORED
        ]
    ),
)
def select_f_reg(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(table(spark, sf, "lineitem").select(*_REG_SCORED, "l_extendedprice"), "l_extendedprice", "chi2")


@query(
    "select_k_best",
    f"select {r('l_extendedprice * (1 - l_discount)')} as net, {r('l_extendedprice')} as l_extendedprice from lineitem",
)
def select_k_best(spark: SparkSession, sf: str) -> DataFrame:
    """The best feature of five for a numeric target, then the target."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    df = table(spark, sf, "lineitem").withColumn("net", net).select(*_REG_SCORED, "net", "l_extendedprice")
    return tidy(S.fit_select(df, "l_extendedprice", max_features=1).transform(df))


def _split_sql(source: str, target: str | None) -> str:
    y = target or "0"
    return f"""c as (select {y} as y, count(*) as n from {source} group by 1),
    t as (select cast(sum(n) as bigint) as total, cast(ceil(sum(n) * 0.2 - 1e-9) as bigint) as k from c),
    q as (select y, n * k // total as whole, n * k % total as rest, k from c, t),
    qq as (select y, whole + (row_number() over (order by rest desc, y) <= k - sum(whole) over ())::int as quota from q),
    parts as (select s.*, case when row_number() over (partition by {y} order by md5(o_orderkey || ':42')) <= quota
      then 'test' else 'train' end as split from {source} s join qq on qq.y = {y})"""


@query("split_stratified", f"with {_split_sql('orders', 'o_orderpriority')} select o_orderkey, o_orderpriority, split from parts")
def split_stratified(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return with_split(df, "o_orderkey", "o_orderpriority")


@query("split_plain", f"with {_split_sql('orders', None)} select o_orderkey, split from parts")
def split_plain(spark: SparkSession, sf: str) -> DataFrame:
    return with_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "split_summary",
    f"""with {GAPS}, known as (select * from gaps where g_cat is not null), {_split_sql("known", "g_cat")}
    select split, count(*) as n_rows, 2::bigint as n_features from parts group by split""",
)
def split_summary_query(spark: SparkSession, sf: str) -> DataFrame:
    df = gaps(spark, sf).select("o_orderkey", "o_totalprice", "g_cat")
    return split_summary(with_split(df, "o_orderkey", "g_cat"), "g_cat")


_CHAIN_COLUMNS = ["o_orderstatus", "o_orderpriority", "o_totalprice", "g_mean", "g_median", "g_drop", "g_cat"]
_CHAIN_SQL = f"""with {GAPS}, f as (select avg(g_mean) as a, quantile_cont(g_median, 0.5) as b from gaps),
    d as (select distinct o_orderstatus, o_orderpriority, o_totalprice, coalesce(g_mean, a) as g_mean,
      coalesce(g_median, b) as g_median, coalesce(g_cat, {_mode("g_cat")}) as g_cat from gaps, f),
    s as (select avg(g_mean) as ma, stddev_pop(g_mean) as sa, avg(g_median) as mb, stddev_pop(g_median) as sb from d)"""


@query(
    "prep_chain",
    f"""{_CHAIN_SQL} select {r("o_totalprice")} as o_totalprice, {r("(g_mean - ma) / sa")} as g_mean,
      {r("(g_median - mb) / sb")} as g_median, {_hot("o_orderstatus", ["F", "O", "P"])},
      {_hot("o_orderpriority", _PRIORITIES)}, {_hot("g_cat", _PRIORITIES)} from d, s""",
)
def prep_chain(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(prepare(gaps(spark, sf).select(*_CHAIN_COLUMNS), {"target_column": "o_totalprice"}).table)


@query(
    "prep_report",
    f"""{_CHAIN_SQL}, n as (select (select count(*) from gaps) as b, (select count(*) from d) as a)
    select cast(row_number() over (order by k) - 1 as int) as position, step, detail from (
      select 0 as k, 'original_shape' as step, b || ' rows, 7 columns' as detail from n
      union all select 1, 'missing_values_handled', 'g_drop'
      union all select 2, 'duplicates_removed', (b - a)::varchar from n where b > a
      union all select 3, 'categorical_encoded', 'o_orderstatus:onehot,o_orderpriority:onehot,g_cat:onehot'
      union all select 4, 'features_scaled', 'standard'
      union all select 5, 'final_shape', a || ' rows, 13 columns' from n)""",
)
def prep_report(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(gaps(spark, sf).select(*_CHAIN_COLUMNS), {"target_column": "o_totalprice"}).report


@query(
    "prep_chain_full",
    f"""with f0 as (select l_quantity, l_extendedprice, l_discount, l_returnflag from lineitem),
    d0 as (select distinct * from f0),
    {_iqr_sql("d0", ["l_quantity", "l_extendedprice", "l_discount"], "1")[5:].rsplit(" select 1", 1)[0]},
    f as (select l_returnflag, l_quantity * l_extendedprice as qe, l_quantity * l_discount as qd,
      l_extendedprice * l_discount as ed, l_quantity as q, l_extendedprice as e, l_discount as d from s2),
    p as (select avg(qe) as m, stddev_pop(qe) as s from f)
    select count(*) as n_rows, {r("sum(abs((qe - m) / s)) / count(*)")} as mean_abs, l_returnflag from f, p group by l_returnflag""",
)
def prep_chain_full(spark: SparkSession, sf: str) -> DataFrame:
    """Outliers and features switched on; checked per class on one feature."""
    df = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    config = {
        "target_column": "l_returnflag",
        "handle_outliers": True,
        "feature_engineering": True,
        "feature_engineering_config": {"interaction_features": True},
    }
    done = prepare(df, config).table
    return tidy(
        done.groupBy("l_returnflag").agg(
            F.count(F.lit(1)).alias("n_rows"), F.avg(F.abs("l_quantity_x_l_extendedprice")).alias("mean_abs")
        )
    )


@query(
    "prep_chain_basic",
    f"""with {GAPS}, f as (select avg(g_knn) as c from gaps),
    b as (select o_orderkey, coalesce(g_knn, c) as g_knn,
      dense_rank() over (order by coalesce(g_cat, {_mode("g_cat")})) - 1 as code from gaps, f),
    s as (select avg(g_knn) as a, stddev_pop(g_knn) as d, avg(code) as ca, stddev_pop(code) as cd from b)
    select o_orderkey, {r("(g_knn - a) / d")} as g_knn, {r("(code - ca) / cd")} as g_cat_encoded from b, s""",
)
def prep_chain_basic(spark: SparkSession, sf: str) -> DataFrame:
    df = gaps(spark, sf).select("o_orderkey", "g_knn", "g_cat")
    return tidy(prepare_basic(df, {"target_column": "o_orderkey"}).table)


@query(
    "prep_reload",
    f"""with {GAPS}, f as (select avg(g_mean) as a, quantile_cont(g_median, 0.5) as b from gaps),
    d as (select o_orderkey, coalesce(g_mean, a) as x, coalesce(g_median, b) as y from gaps, f),
    s as (select avg(x) as mx, stddev_pop(x) as sx, avg(y) as my, stddev_pop(y) as sy from d)
    select o_orderkey, {r("(x - mx) / sx")} as g_mean, {r("(y - my) / sy")} as g_median from d, s""",
)
def prep_reload(spark: SparkSession, sf: str) -> DataFrame:
    """A fitted chain written, read back and applied."""
    import uuid

    from rowmill.functions.storage import checkpoint_folder

    df = gaps(spark, sf).select("o_orderkey", "g_mean", "g_median")
    fill = M.fit_impute(df, "auto", protect=["o_orderkey"])
    scale = fit_scale(fill.transform(df), "standard", protect=["o_orderkey"])
    path = f"{checkpoint_folder(spark)}/chains/{uuid.uuid4().hex}"
    Chain([fill, scale]).save(spark, path)
    return tidy(Chain.load(spark, path).transform(df))


@query(
    "align_features",
    f"select o_orderkey, 0 as absent, {r('o_totalprice')} as o_totalprice, o_orderstatus from orders",
)
def align(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders")
    return tidy(align_features(df, ["absent", "o_totalprice", "o_orderstatus"], ["o_orderkey"]))
