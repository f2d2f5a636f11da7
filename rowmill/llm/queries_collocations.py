"""Query of the collocations, and its definition in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowmill.llm.collocations import INSIDE_PERCENT, LIMIT, MIN_COUNT, SCORE_UNIT, collocations
from rowmill.llm.registry import query, table

_SCORE = f"({SCORE_UNIT}::hugeint * a * a) // (l::hugeint * r)"

SQL = f"""
with pieces as (
  select lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) as piece
  from (select coalesce(lang, 'und') as lang, text from documents)),
numbered as (
  select lang, row_number() over () as id, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda p: p <> '') as words from pieces),
placed as (
  select lang, id, unnest(range(1, len(words) + 1)) as pos, unnest(words) as w from numbered),
ahead as (
  select lang, w, lead(w) over k as x, lead(w, 2) over k as y from placed window k as (partition by id order by pos)),
f1 as (select lang, w, count(*) as f from ahead group by lang, w),
f2 as (select lang, w, x, count(*) as f from ahead where x is not null group by lang, w, x),
f3 as (select lang, w, x, y, count(*) as f from ahead where y is not null group by lang, w, x, y having count(*) >= {MIN_COUNT}),
sizes as (select lang, sum(f)::bigint as n from f1 group by lang),
struck as (
  select f2.lang, f2.w, f2.x from f2 join f3 on f2.lang = f3.lang and f2.w = f3.w and f2.x = f3.x and 100 * f3.f >= {INSIDE_PERCENT} * f2.f
  union select f2.lang, f2.w, f2.x from f2 join f3 on f2.lang = f3.lang and f2.w = f3.x and f2.x = f3.y and 100 * f3.f >= {INSIDE_PERCENT} * f2.f),
cuts as (
  select f2.lang, f2.w || ' ' || f2.x as phrase, f2.f as a, 1 as k, p.f as l, q.f as r
  from f2 join f1 p on p.lang = f2.lang and p.w = f2.w join f1 q on q.lang = f2.lang and q.w = f2.x
  where f2.f >= {MIN_COUNT} and (f2.lang, f2.w, f2.x) not in (select (lang, w, x) from struck)
  union all
  select f3.lang, f3.w || ' ' || f3.x || ' ' || f3.y, f3.f, 1, p.f, q.f
  from f3 join f1 p on p.lang = f3.lang and p.w = f3.w join f2 q on q.lang = f3.lang and q.w = f3.x and q.x = f3.y
  union all
  select f3.lang, f3.w || ' ' || f3.x || ' ' || f3.y, f3.f, 2, p.f, q.f
  from f3 join f2 p on p.lang = f3.lang and p.w = f3.w and p.x = f3.x join f1 q on q.lang = f3.lang and q.w = f3.y),
lowest as (
  select *, {_SCORE} as score from cuts qualify row_number() over (partition by lang, phrase order by {_SCORE}, k) = 1),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join sizes using (lang) where rank <= {LIMIT}"""


@query("op12_phrase_collocations", SQL)
def op12_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(table(spark, sf, "documents"))
