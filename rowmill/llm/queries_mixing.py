"""Query of the mixing, and its definition in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowmill.llm.mixing import EPOCHS, QUANTUM, SEED, mix
from rowmill.llm.registry import query, table

SQL = f"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
sources as (
  select source, source_size, no, (no - 1) % 3 + 1 as weight from (
    select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as no
    from sized group by source)),
budget as (select coalesce(sum(size), 0)::bigint as budget from sized),
levels as (
  select (budget - coalesce(sum({EPOCHS} * source_size) over (order by {EPOCHS} * source_size::double / weight, no
      rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over (order by {EPOCHS} * source_size::double / weight, no rows between current row and unbounded following))::double as level
  from sources, budget),
targets as (
  select *, least(({EPOCHS} * source_size)::double, weight::double * (select max(level) from levels)) as target from sources),
turns as (
  select d.doc_id, d.size, t.no, t.source_size, t.target,
    unnest(range(0, greatest(1, least({EPOCHS}, case when t.source_size > 0 then ceil(t.target / t.source_size)::bigint else 1 end)))) as epoch
  from sized d join targets t on d.source is not distinct from t.source),
queued as (
  select *, epoch * source_size + sum(size) over (partition by no, epoch order by key, doc_id
    rows between unbounded preceding and current row) as finish_at
  from (select *, md5(concat_ws(':', '{SEED}', epoch::varchar, doc_id::varchar)) as key from turns)),
packets as (
  select *, unnest(case when finish_at - size < target and finish_at > target then range(0, size, {QUANTUM}) else [0] end) as first_word,
    finish_at - size < target and finish_at > target as across
  from queued),
timed as (
  select *, case when target > 0 then (finish_at - size + first_word + n_words)::double / target when size > 0 then 'infinity'::double
    else 0 end as finish
  from (select *, case when across then least(size - first_word, {QUANTUM}) else size end as n_words from packets)),
merged as (
  select *, sum(n_words) over (order by finish, no, epoch, key, doc_id, first_word
    rows between unbounded preceding and current row) as spent
  from timed)
select doc_id, size, source_size, target,
  sum(greatest(0, least(n_words, budget - (spent - n_words))))::bigint as taken
from merged, budget group by doc_id, size, source_size, target"""


@query("op13_source_mixing", SQL)
def op13_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents")).drop("source")
