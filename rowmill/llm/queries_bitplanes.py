"""Query of the centroid clustering, and its definition in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowmill.llm.bitplanes import CENTROIDS, ROUNDS, SCALE, SEED, WIDTH, cluster, digest
from rowmill.llm.registry import query, table


def _round(n: int) -> str:
    """Assignment to the centroids ``c{n}`` and the centroids after it."""
    return f"""
near{n} as (
  select id, cluster, distance from (
    select v.id, c.cluster, sum((v.x - c.x) * (v.x - c.x))::bigint as distance,
      row_number() over (partition by v.id order by sum((v.x - c.x) * (v.x - c.x)), c.cluster) as place
    from parts v join c{n} c using (i) group by v.id, c.cluster) where place = 1),
sums{n} as (
  select cluster, i, sum(x)::bigint as s, count(*) as m from parts join near{n} using (id) group by cluster, i),
c{n + 1} as (
  select c.cluster, c.i, coalesce((s - ((s % m) + m) % m) // m, c.x)::bigint as x
  from c{n} c left join sums{n} using (cluster, i))"""


SQL = f"""
with kept as (
  select vec_id, row_number() over (order by vec_id) as id, embedding from embeddings
  where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {WIDTH}),
parts as (
  select id, unnest(range(1, {WIDTH} + 1)) as i, unnest(list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint)) as x
  from kept),
seeds as (
  select id, row_number() over (order by sha256('{SEED}:' || vec_id::varchar)) - 1 as cluster from kept
  qualify cluster < {CENTROIDS}),
c0 as (select cluster, i, x from parts join seeds using (id)),
{",".join(_round(n) for n in range(ROUNDS + 1))},
texts as (select cluster, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from c{ROUNDS} group by cluster)
select vec_id, cluster::int as cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
  (sum(distance) over ())::bigint as inertia, centroid_sha256
from near{ROUNDS} join kept using (id) join texts using (cluster)"""


@query("op11_centroid_clustering", SQL)
def op11_centroid_clustering(spark: SparkSession, sf: str) -> DataFrame:
    return digest(cluster(table(spark, sf, "embeddings")))
