"""CSV records that go over several lines, cut by many tasks.

A line may open or close a quoted value, depending on whether it starts inside
one.  Each block of a file is first reduced to where it would end from either
start; the blocks' outcomes are chained per file, so every block knows how it
starts, and tasks then join their own lines to records.  Only the pieces of
records that cross a block's edge are shuffled.

A quote opens a value only at the start of a field; elsewhere it is text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted value is open behind ``line``."""
    at = 0
    while True:
        if inside:
            close = line.find('"', at)
            while close >= 0 and line[close + 1 : close + 2] == '"':
                close = line.find('"', close + 2)
            if close < 0:
                return True
            at, inside = close + 1, False
        elif line[at : at + 1] == '"':
            at, inside = at + 1, True
            continue
        # The rest of the field is text.
        at = line.find(sep, at) + 1
        if not at:
            return False


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Lines of one block after the other, in order; a block may come in parts."""
    for batch in batches:
        file, start = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        lines = batch.column(2).to_pylist()
        cuts = [0, *(np.flatnonzero((np.diff(start) != 0) | (np.array(file[1:]) != np.array(file[:-1]))) + 1).tolist(), len(lines)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield (file[a], int(start[a])), lines[a:b]


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """``file, start (of the block), line`` in the order of the scan."""
    text = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", "value")
    line = F.col("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), F.lit(encoding))
    return text.select(F.col("file_path").alias("file"), F.col("file_block_start").alias("start"), line.alias("line"))


def read_records(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """``(file, first, record)``: whole records with their line breaks; ``first``
    marks the first record of each file.  Blank lines between records are left out."""
    lines = _lines(spark, path, encoding)

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[bool]] = {}
        for block, part in _blocks(batches):
            ends = held.setdefault(block, [False, True])
            for line in part:
                if '"' in line:
                    for i in (0, 1):
                        ends[i] = ends_inside(line, ends[i], sep)
        rows = [(*block, *ends) for block, ends in held.items()]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
        names = ["file", "start", "from_out", "from_in"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    # One row per block of the input.
    found = lines.mapInArrow(outcomes, "file string, start long, from_out boolean, from_in boolean").toArrow().to_pylist()
    opens, before = {}, {}
    for r in sorted(found, key=lambda r: (r["file"], r["start"])):
        inside = before.get(r["file"], False)
        if inside:
            opens[(r["file"], r["start"])] = True
        before[r["file"]] = r["from_in"] if inside else r["from_out"]
    shared = spark.sparkContext.broadcast(opens)
    firsts = {}
    for r in found:
        firsts[r["file"]] = min(r["start"], firsts.get(r["file"], r["start"]))
    first_blocks = spark.sparkContext.broadcast(firsts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records with ``edge``: 0 whole, 1 goes on in the next block, 2 begun in
        an earlier one."""
        block, inside, parts, edge, seen = None, False, [], 0, False

        def row(record: str, kind: int) -> tuple:
            return (*block, record, kind, not seen and first_blocks.value[block[0]] == block[1])

        for at, part in _blocks(batches):
            out = []
            if at != block:
                if parts:
                    out.append(row("\n".join(parts), 2 if edge else 1))
                block, parts, seen = at, [], False
                inside = shared.value.get(at, False)
                edge = 2 if inside else 0
            for line in part:
                if not inside and not parts and not line.strip():
                    continue
                inside = ends_inside(line, inside, sep) if '"' in line else inside
                parts.append(line)
                if not inside:
                    out.append(row("\n".join(parts), edge))
                    seen, parts, edge = True, [], 0
            yield _records(out)
        if parts:
            yield _records([row("\n".join(parts), 2 if edge else 1)])

    kinds = "file string, start long, record string, edge int, first boolean"
    cut_rows = lines.mapInArrow(cut, kinds)
    whole = cut_rows.filter("edge = 0").select("file", "first", "record")
    pieces = cut_rows.filter("edge > 0")
    # A run of pieces begins with edge 1; those behind it up to the next run belong to it.
    glued = (
        pieces.groupBy("file")
        .agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("edge")).alias("order"), "record", "first"))).alias("p"))
        .select("file", F.explode(F.expr(_GLUE)).alias("g"))
        .select("file", F.col("g.first").alias("first"), F.col("g.record").alias("record"))
    )
    return whole.unionByName(glued)


# Pieces of a file in order: within a block the one that ends an earlier record
# (edge 2) stands before the one that begins the next (edge 1).
_GLUE = """aggregate(p, cast(array() as array<struct<record:string, first:boolean>>),
  (done, x) -> if(x.order = -1 or size(done) = 0, array_append(done, named_struct('record', x.record, 'first', x.first)),
    concat(slice(done, 1, size(done) - 1), array(named_struct('record',
      concat_ws('\\n', element_at(done, -1).record, x.record), 'first', element_at(done, -1).first)))))"""


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["file", "start", "record", "edge", "first"]
    )
