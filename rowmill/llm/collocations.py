"""Phrase collocations by best-first branch and bound.

Phrases grow word by word from their prefixes.  The counts of words, then of
pairs of frequent words, are exact; a pair (w, x) is a node whose bound
``1000000 * f(w x) / f(w)`` no longer phrase beginning with it can pass, since
a phrase is as frequent as any of its parts at most; likewise none that ends with
(x, y) passes ``1000000 * f(x y) / f(y)``.  Per language the frontier is
expanded from the best bounds down to a floor: triples are counted whose two
bounds reach it, or that hold a pair whose own score does (a longer phrase may
strike it out).  All scores from the floor up are then settled.  A language is
done once ``limit`` phrases survive there, ties included, or its frontier is
empty; otherwise its floor is lowered and more nodes are expanded.

Counting is one scan per step.  Tasks split texts on their bytes, code words and
phrases per slice, and hand over counts; which words or pairs may be grown comes
to them as a bitmap of hashed keys.  A false hit in the bitmap only has a phrase
counted needlessly: every count is complete, and all decisions use the counts.

Defined results: A-Z are lower-cased; a NULL text is empty; a NULL language is
``und``; repeated rows count separately; ranks order by score and count
descending, then by the phrase's bytes; an empty table gives no rows; only
``lang`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowmill.functions.lookup import BROADCAST_BYTES
from rowmill.functions.storage import settle
from rowmill.llm.shingles import mix

MIN_COUNT = 10
LIMIT = 2000
#: Percent of a phrase's occurrences inside one longer phrase that strike it out.
INSIDE_PERCENT = 50
SCORE_UNIT = 1_000_000
#: Classes of scores per power of two.
CLASSES = 32
#: First floor: as many pair scores lie above it as ``limit`` times this.
AHEAD = 2

#: Text bytes a task codes at a time.
SLICE_BYTES = 1 << 20
#: Bits of the key bitmap per key, and its largest size (32 MB).
BITS_PER_KEY, MOST_BITS = 32, 1 << 28
#: Estimated bytes of one pair's row in a broadcast join.
PAIR_BYTES = 96

# Byte classes: 0 in a word, 1 blank, 2 end of a piece.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: What a bitmap key stands for.
WORD, PAIR, HEAD, TAIL, SETTLE = 1, 2, 3, 4, 5


class Words:
    """The words of one slice of documents as codes into ``names``."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        data = _LOWER[np.frombuffer(held, np.uint8)[ends[0] : ends[-1]]] if held else np.empty(0, np.uint8)
        ends = ends - ends[0]
        kind = _CLASS[data]
        inside = kind == 0
        # A document's first byte starts a word even where the one before has no blank at its end.
        first = np.zeros(len(data) + 1, bool)
        first[ends[:-1]] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        starts |= inside & first[:-1]
        at = np.flatnonzero(starts)
        sizes = np.add.reduceat(inside.astype(np.int64), at) if len(at) else np.empty(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        column = pa.Array.from_buffers(
            pa.large_binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[inside].tobytes())]
        )
        coded = column.dictionary_encode()
        self.names = coded.dictionary
        self.code = coded.indices.to_numpy().astype(np.int64)
        doc = np.searchsorted(ends, at, side="right") - 1
        tags = pc.fill_null(langs, "und").dictionary_encode()
        self.langs = tags.dictionary
        self.lang = tags.indices.to_numpy().astype(np.int64)[doc]
        # Two neighbours share a piece if no break and no document start lies between them.
        breaks = np.cumsum((kind == 2) | first[:-1])
        piece = breaks[at]
        self.next = np.zeros(len(at), bool)
        self.next[:-1] = piece[1:] == piece[:-1]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        return _hashed(self.langs.to_pylist()), _hashed(self.names.to_pylist())


def _hashed(values: list) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values), np.uint64, len(values))


def _keys(kind: int, lang: np.ndarray, first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    out = mix(lang + np.uint64(kind)) + first
    return mix(out if second is None else mix(out) + second)


class Bitmap:
    """A set of hashed keys; membership may say yes wrongly, never no."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys & np.uint64(self.bits - 1)
        word = self.words[(place >> np.uint64(6)).astype(np.int64)]
        return (word >> (place & np.uint64(63))) & np.uint64(1) == 1


def _placer(kind: int, bits: int, pair: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_hashed(batch.column(i).to_pylist()) for i in range(3 if pair else 2)]
            place = _keys(kind, *parts) & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((place & np.uint64(63)).astype(np.int32))],
                ["word", "bit"],
            )

    return run


def bitmap(sets: list[tuple[int, DataFrame]]) -> Bitmap:
    """``sets``: what a key stands for, and its ``(lang, first[, second])``.

    Sized by the number of keys up to ``MOST_BITS``; the driver gets its set
    words, 32 MB at most.  Beyond that size more false hits are counted.
    """
    total = sum(keys.count() for _, keys in sets)
    bits = 1 << max(12, min(MOST_BITS.bit_length() - 1, (BITS_PER_KEY * total).bit_length()))
    places = None
    for kind, keys in sets:
        rows = keys.mapInArrow(_placer(kind, bits, len(keys.columns) == 3), "word long, bit int")
        places = rows if places is None else places.unionByName(rows)
    filled = places.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")).toArrow()
    words = np.zeros(bits >> 6, np.int64)
    words[filled.column("word").to_numpy()] = filled.column("mask").to_numpy()
    return Bitmap(words.view(np.uint64), bits)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Documents in slices of about ``SLICE_BYTES``; a longer text is one slice."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes.astype(np.int64)), 0
        while at < len(ends):
            done = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
            yield Words(batch.column(0).slice(at, upto - at), batch.column(1).slice(at, upto - at))
            at = upto


def _counts(words: Words, lang: np.ndarray, parts: list[np.ndarray], n: np.ndarray, width: int) -> pa.RecordBatch:
    text = [words.langs.take(pa.array(lang)).cast(pa.string())]
    text += [words.names.take(pa.array(p)).cast(pa.string()) for p in parts]
    return pa.RecordBatch.from_arrays([*text, pa.array(n, pa.int64())], ["lang", "w", "x", "y"][: width + 1] + ["n"])


def _singles(words: Words, held: Bitmap | None) -> pa.RecordBatch:
    key, n = np.unique(words.lang * len(words.names) + words.code, return_counts=True)
    return _counts(words, key // len(words.names), [key % len(words.names)], n, 1)


def _pairs(words: Words, held: Bitmap) -> pa.RecordBatch:
    """Pairs of neighbours that are both frequent words."""
    size = len(words.names)
    single, back = np.unique(words.lang * size + words.code, return_inverse=True)
    langs, names = words.hashes()
    frequent = held.has(_keys(WORD, langs[single // size], names[single % size]))[back]
    at = np.flatnonzero(words.next[:-1] & frequent[:-1] & frequent[1:])
    key, n = np.unique(back[at] * size + words.code[at + 1], return_counts=True)
    lead = single[key // size]
    return _counts(words, lead // size, [lead % size, key % size], n, 2)


def _triples(words: Words, held: Bitmap) -> pa.RecordBatch:
    """Triples of two frequent pairs: a head and a tail, or one to be settled."""
    size = len(words.names)
    single, back = np.unique(words.lang * size + words.code, return_inverse=True)
    langs, names = words.hashes()
    at = np.flatnonzero(words.next[:-2] & words.next[1:-1])
    # Pairs that begin or end a triple, each once.
    both = np.flatnonzero(words.next[:-1])
    pair, which = np.unique(back[both] * size + words.code[both + 1], return_inverse=True)
    number = np.full(len(words.code), -1, np.int64)
    number[both] = which
    lead = single[pair // size]
    parts = (langs[lead // size], names[lead % size], names[pair % size])
    frequent, head, tail, open_ = (held.has(_keys(kind, *parts)) for kind in (PAIR, HEAD, TAIL, SETTLE))
    first, second = number[at], number[at + 1]
    chosen = frequent[first] & frequent[second] & (head[first] & tail[second] | open_[first] | open_[second])
    at, first = at[chosen], first[chosen]
    key, n = np.unique(first * size + words.code[at + 2], return_counts=True)
    begun = pair[key // size]
    lead = single[begun // size]
    return _counts(words, lead // size, [lead % size, begun % size, key % size], n, 3)


def _count(docs: DataFrame, width: int, held: Bitmap | None) -> DataFrame:
    """``(lang, w[, x[, y]], n)`` over all occurrences in ``docs``."""
    count = {1: _singles, 2: _pairs, 3: _triples}[width]
    names = ["lang", "w", "x", "y"][: width + 1]
    # Tasks read the bitmap once per worker, not once per task closure.
    shared = docs.sparkSession.sparkContext.broadcast((held.words, held.bits)) if held else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bitmap(*shared.value) if shared else None
        for words in _slices(batches):
            if len(words.code) >= width:
                yield count(words, known)

    rows = docs.select("lang", "text").mapInArrow(run, ", ".join(f"{c} string" for c in names) + ", n long")
    return rows.groupBy(*names).agg(F.sum("n").alias("n"))


def _sized(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows * PAIR_BYTES <= BROADCAST_BYTES else table


def _score(a: Column, left: Column, right: Column) -> Column:
    """``floor(1000000 * a * a / (l * r))`` without rounding."""
    big = lambda c: c.cast("decimal(20,0)")
    top = (big(a) * big(a)).cast("decimal(31,0)") * F.lit(SCORE_UNIT).cast("decimal(7,0)")
    return F.call_function("div", top, big(left) * big(right))


def _floors(scored: DataFrame, above: int) -> DataFrame:
    """Per language a score floor at most as high as its ``above``-th best.

    Scores are counted in logarithmic classes, so a language's window is short.
    """
    classes = scored.groupBy("lang", F.floor(F.log2(F.col("score") + 1) * CLASSES).alias("k")).agg(F.count(F.lit(1)).alias("m"))
    down = Window.partitionBy("lang").orderBy(F.desc("k"))
    reached = F.sum("m").over(down.rowsBetween(Window.unboundedPreceding, 0)) >= above
    # A class's lowest score, or just below it; 0 where all scores are too few.
    least = F.floor(F.pow(F.lit(2.0), F.col("k") / CLASSES) - 1)
    return classes.withColumn("floor", F.when(reached, least)).groupBy("lang").agg(F.coalesce(F.max("floor"), F.lit(0)).alias("floor"))


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, limit: int = LIMIT, inside_percent: int = INSIDE_PERCENT
) -> DataFrame:
    """Each language's first ``limit`` phrases of two or three words:
    ``lang, rank, phrase, a, l, r, n, score``."""
    text = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    enough = F.col("n") >= min_count

    # Roots: words.  All are counted, the frequent ones are kept.
    counted = settle(_count(text, 1, None))
    totals = settle(counted.groupBy("lang").agg(F.sum("n").alias("total")))
    singles = settle(counted.filter(enough))
    n_singles = singles.count()

    # First step: every frequent word is a node; its bound alone excludes nothing.
    pairs = _count(text, 2, bitmap([(WORD, singles.select("lang", "w"))])).filter(enough)
    single = _sized(singles, n_singles)
    left = single.select("lang", "w", F.col("n").alias("fw"))
    right = single.select("lang", F.col("w").alias("x"), F.col("n").alias("fx"))
    pairs = pairs.join(left, ["lang", "w"]).join(right, ["lang", "x"])
    pairs = settle(
        pairs.withColumns(
            {
                "score": _score(F.col("n"), F.col("fw"), F.col("fx")),
                "begins": F.expr(f"{SCORE_UNIT}L * n div fw"),
                "ends": F.expr(f"{SCORE_UNIT}L * n div fx"),
            }
        )
    )
    n_pairs, key = pairs.count(), ["lang", "w", "x"]

    floors, done, ahead = settle(_floors(pairs, AHEAD * limit)), [], AHEAD
    while True:
        # One row per language that is not done.
        nodes = pairs.join(F.broadcast(floors), "lang")
        kinds = [(PAIR, nodes), (HEAD, nodes.filter("begins >= floor")), (TAIL, nodes.filter("ends >= floor"))]
        kinds.append((SETTLE, nodes.filter("score >= floor")))
        triples = settle(_count(text, 3, bitmap([(kind, rows.select(*key)) for kind, rows in kinds])).filter(enough))
        pair = _sized(pairs, n_pairs)
        head = pair.select("lang", "w", "x", "fw", F.col("n").alias("fwx"))
        tail = pair.select("lang", F.col("w").alias("x"), F.col("x").alias("y"), F.col("n").alias("fxy"), F.col("fx").alias("fy"))
        joined = settle(triples.join(head, ["lang", "w", "x"]).join(tail, ["lang", "x", "y"]))
        best = settle(_survivors(nodes.drop("floor"), joined, inside_percent).join(F.broadcast(floors), "lang").filter("score >= floor"))
        number = best.groupBy("lang").agg(F.count(F.lit(1)).alias("m"))
        judged = settle(floors.join(number, "lang", "left").withColumn("open", F.expr(f"floor > 0 and coalesce(m, 0) < {limit}")))
        done.append(best.join(F.broadcast(judged.filter("not open").select("lang")), "lang"))
        short = judged.filter("open").select("lang")
        if short.isEmpty():
            break
        ahead *= 4
        floors = settle(_floors(pairs.join(F.broadcast(short), "lang"), ahead * limit))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return _ranked(out, totals, limit)


def _survivors(pairs: DataFrame, triples: DataFrame, inside_percent: int) -> DataFrame:
    """Pairs no triple strikes out, and triples, with their lowest cut."""
    mostly = lambda part: F.col("n") * 100 >= F.col(part) * inside_percent
    heads = triples.filter(mostly("fwx")).select("lang", "w", "x")
    tails = triples.filter(mostly("fxy")).select("lang", F.col("x").alias("w"), F.col("y").alias("x"))
    left = pairs.join(heads.unionByName(tails).distinct(), ["lang", "w", "x"], "left_anti")
    two = left.select("lang", F.concat_ws(" ", "w", "x").alias("phrase"), F.col("n").alias("a"), F.col("fw").alias("l"),
                      F.col("fx").alias("r"), "score")
    early, late = _score(F.col("n"), F.col("fw"), F.col("fxy")), _score(F.col("n"), F.col("fwx"), F.col("fy"))
    cut = triples.withColumns({"early": early, "late": late}).withColumn("first", F.col("early") <= F.col("late"))
    three = cut.select(
        "lang",
        F.concat_ws(" ", "w", "x", "y").alias("phrase"),
        F.col("n").alias("a"),
        F.when(F.col("first"), F.col("fw")).otherwise(F.col("fwx")).alias("l"),
        F.when(F.col("first"), F.col("fxy")).otherwise(F.col("fy")).alias("r"),
        F.least("early", "late").alias("score"),
    )
    return two.unionByName(three)


def _ranked(best: DataFrame, totals: DataFrame, limit: int) -> DataFrame:
    """Spark keeps ``limit`` rows per language in every task before the shuffle."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    joined = first.join(F.broadcast(totals), "lang")
    return joined.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
