"""Query of the line dedup, and its definition in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm.lines import RUN_WORDS, dedup_lines
from rowmill.llm.registry import query, table

SQL = f"""
with split as (
  select doc_id, text, string_split(coalesce(text, ''), chr(10)) as parts from documents),
placed as (
  select doc_id, parts[pos] as line, pos - 1 as pos
  from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as pos from split)),
lines as (
  select doc_id, line, pos, len(string_split(trim(line), ' ')) as n,
    row_number() over (partition by doc_id order by pos) as k
  from placed where trim(line) <> ''),
ahead as (
  select doc_id, pos, n, line, lead(line) over w as line2, lead(line, 2) over w as line3,
    lead(pos) over w as at2, lead(pos, 2) over w as at3, lead(n) over w as n2
  from lines window w as (partition by doc_id order by k)),
windows as (
  select doc_id, pos as first_at, at3 as last_at, [line, line2, line3] as passage from ahead where at3 is not null
  union all select doc_id, pos, pos, [line] from ahead where n >= {RUN_WORDS}
  union all select doc_id, pos, at2, [line, line2] from ahead where n < {RUN_WORDS} and at2 is not null and n + n2 >= {RUN_WORDS}),
ranked as (
  select *, row_number() over (partition by passage order by doc_id, first_at) as place from windows),
cuts as (
  select doc_id, list_sort(list_distinct(flatten(list(range(first_at, last_at + 1))))) as cut
  from ranked where place > 1 group by doc_id),
left_over as (
  select doc_id, parts, cut, list_filter(parts, lambda p, i: not list_contains(coalesce(cut, []), i - 1)) as kept, text
  from split left join cuts using (doc_id))
select doc_id, len(parts) as n_lines, coalesce(len(cut), 0) as n_cut, coalesce(array_to_string(cut, ','), '') as cut_lines,
  md5(case when cut is null then text when len(list_filter(kept, lambda p: trim(p) <> '')) = 0 then ''
    else array_to_string(kept, chr(10)) end) as text_md5
from left_over"""


@query("op6_line_dedup", SQL)
def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    done = dedup_lines(docs.withColumn("n_lines", lines.cast("long")), cut="cut")
    return done.select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_cut"),
        F.coalesce(F.array_join("cut", ","), F.lit("")).alias("cut_lines"),
        F.md5("text").alias("text_md5"),
    )
