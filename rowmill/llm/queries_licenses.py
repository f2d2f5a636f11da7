"""Query of the license scan, and the same voting in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowmill.llm import licenses
from rowmill.llm.registry import query, table


def _values() -> str:
    return ", ".join(
        f"({t.id}, '{t.label}', {str(t.base).lower()}, {len(t.words)}, {at}, '{t.words[at]}', '{t.words[at + 1]}')"
        for t in licenses.templates()
        for at in range(len(t.words) - licenses.GRAM + 1)
    )


SQL = f"""
with templates(template, label, base, size, tpos, one, two) as (values {_values()}),
worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents),
grams as (
  select doc_id, pos - 1 as pos, words[pos] as one, words[pos + 1] as two
  from (select doc_id, words, unnest(range(1, len(words))) as pos from worded)),
hits as (
  select doc_id, template, label, base, size, pos, tpos, pos - tpos as diagonal
  from grams join templates using (one, two)),
diagonals as (
  select doc_id, template, label, base, size, diagonal, list(tpos) as ats, min(pos) as first_pos, max(pos) + 2 as last_pos
  from hits group by doc_id, template, label, base, size, diagonal),
stepped as (
  select *, coalesce(diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) > {licenses.MERGE_GAP}, true) as fresh
  from diagonals),
grouped as (
  select *, sum(case when base or fresh then 1 else 0 end) over (partition by doc_id, template order by diagonal) as grp
  from stepped),
merged as (
  select doc_id, template, label, base, size, grp, min(first_pos) as first_pos, max(last_pos) as last_pos,
    len(list_distinct(flatten(list(ats)))) / (size - 1) as coverage
  from grouped group by doc_id, template, label, base, size, grp),
judged as (
  select *, base or last_pos - first_pos <= {licenses.STRETCH} * size as fits
  from (select *, case when base or size <= {licenses.SHORT} then 1.0 else {licenses.COVERAGE} end as least from merged)
  where coverage >= least),
close_hits as (
  select distinct j.doc_id, j.template, j.grp, j.label, j.size, j.least, h.pos, h.tpos
  from judged j join grouped g using (doc_id, template, grp) join hits h on h.doc_id = g.doc_id and h.template = g.template
    and h.diagonal = g.diagonal
  where not j.fits),
first_met as (
  select a.doc_id, a.template, a.grp, a.label, a.size, a.least, a.pos as first_pos, b.tpos, min(b.pos) as met
  from (select distinct doc_id, template, grp, label, size, least, pos from close_hits) a
    join close_hits b on b.doc_id = a.doc_id and b.template = a.template and b.grp = a.grp
      and b.pos >= a.pos and b.pos + 2 - a.pos <= {licenses.STRETCH} * a.size
  group by all),
spans as (
  select doc_id, template, grp, label, count(*) / (size - 1) as coverage, first_pos, max(met) + 2 as last_pos
  from first_met group by doc_id, template, grp, label, size, least, first_pos having count(*) / (size - 1) >= least),
verified as (
  select doc_id, label, base, coverage, first_pos from judged where fits
  union all
  select doc_id, label, false, coverage, first_pos from spans s where not exists (
    select 1 from spans o where o.doc_id = s.doc_id and o.template = s.template and o.grp = s.grp
      and o.first_pos < s.last_pos and s.first_pos < o.last_pos
      and (-o.coverage, o.last_pos - o.first_pos, o.first_pos, o.last_pos) < (-s.coverage, s.last_pos - s.first_pos, s.first_pos, s.last_pos))),
told as (
  select doc_id, count(*) filter (where base) as n_base, min(first_pos) filter (where base) as first_word,
    max(first_pos) filter (where base) as last_word,
    coalesce(string_agg(distinct label, ',' order by label) filter (where base), '') as base_labels,
    string_agg(distinct label, ',' order by label) as labels, max(coverage) as score
  from verified group by doc_id)
select doc_id, len(words) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from worded left join told using (doc_id)"""


@query("op2_license_scan", SQL)
def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents")).drop("spans")
