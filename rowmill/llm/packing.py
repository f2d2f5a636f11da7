"""Best-fit packing of tokenised documents into sequences.

A document's ids are those of the tokenizer and a closing id; longer documents
are cut into pieces of the sequence length.  Pieces are dealt by a hash of
their row number into groups of some thousand, each packed in one task: best
fit, longest first, then a local search that empties the least filled bin by
moving pieces to other underfull bins or exchanging one for one and two for
one, always to the fuller side, so the sum of squared fills grows.  Bins a
group leaves poorly filled are dissolved and their pieces packed again with
those of other groups, until a round saves no bin.

Defined results: a NULL or empty text is the closing id alone; repeated rows
are packed each; ties are broken by row order; an empty table gives no rows;
only the id and text columns are read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.functions.storage import settle

LENGTH = 2048
CLOSING = 0
GROUP = 3000
#: Bins filled below this share go into the next round.
POOR = 0.98
#: A worker's cache of tokenised words is emptied at this size.
CACHE_WORDS = 600_000

# Where a text holds only these characters, the tokenizer's normaliser is
# lower-casing and its pre-tokens are the words below (fixed values of the
# vocabulary file); other texts are encoded whole.
_PLAIN = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")
_WORD_END = "</w>"


class Codes(dict):
    """word -> its place in the table of ids; new words are listed."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.count = 0

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        code = self[word] = self.count
        self.count += 1
        return code


class Encoder:
    """Texts to 32-bit ids; words met before come from a table."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True
        vocab = self._tok.get_vocab()
        self._ends = np.zeros(max(vocab.values()) + 1, bool)
        self._ends[[i for w, i in vocab.items() if w.endswith(_WORD_END)]] = True
        self._clear()

    def _clear(self) -> None:
        self._codes = Codes()
        self._flat, self._sizes = np.empty(0, "<u4"), np.empty(0, np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self._tok.encode(text, add_special_tokens=False).ids, "<u4")

    def _ids(self, words: list[str]) -> Iterator[np.ndarray]:
        """Ids of new words, encoded together; every word closes with an end token."""
        for at in range(0, len(words), 4000):
            part = words[at : at + 4000]
            ids = np.asarray(self._tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self._ends[ids]) + 1
            yield from np.split(ids, ends[:-1]) if len(ends) == len(part) else map(self._whole, part)

    def _learn(self) -> None:
        """Add the new words to the table, in the order of their codes."""
        new, self._codes.new = self._codes.new, []
        plain = self._ids([w for w in new if w[0] != "\n"])
        made = [next(plain) if w[0] != "\n" else self._whole(w[1:]) if len(w) > 1 else np.asarray([CLOSING], "<u4") for w in new]
        self._flat = np.concatenate([self._flat, *made])
        self._sizes = np.concatenate([self._sizes, np.fromiter(map(len, made), np.int64, len(made))])
        for w in new:
            if w[0] == "\n" and len(w) > 1:
                del self._codes[w]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, each closed by its closing id, and where each
        text ends."""
        if len(self._codes) > CACHE_WORDS or len(self._flat) > 8 * CACHE_WORDS:
            self._clear()
        # No word holds a line break: a text encoded whole, or the closing id alone, is marked by one.
        items: list[str] = []
        counts = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            before = len(items)
            if t and _PLAIN.search(t):
                items.append("\n" + t)
            elif t:
                items += _WORDS.findall(t.lower())
            items.append("\n")
            counts[i] = len(items) - before
        code = np.fromiter(map(self._codes.__getitem__, items), np.int64, len(items))
        if self._codes.new:
            self._learn()
        starts, sizes = np.cumsum(self._sizes) - self._sizes, self._sizes[code]
        ends = np.cumsum(sizes)
        ids = self._flat[np.repeat(starts[code] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, ends[np.cumsum(counts) - 1]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """A worker's encoder: its word cache serves all tasks of the worker."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """``docs``: doc_id, text.  Per piece: doc_id, piece, start, length,
    ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = encoder(tokenizer), ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, ends = known.encode(part.column("text").to_pylist())
                sizes = np.diff(ends, prepend=0)
                many = -(-sizes // length)
                doc = np.repeat(np.arange(len(sizes)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * length
                kept = np.minimum(length, sizes[doc] - start)
                first = (ends - sizes)[doc] + start
                data = memoryview(np.ascontiguousarray(ids)).cast("B")
                sums = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), kept.tolist(), strict=True)]
                columns = [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(kept)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.int64())], names)

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, limit: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    open_by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(int(i))
        else:
            b, room = len(bins), limit
            bins.append([int(i)])
        left = room - size
        open_by_room[left].append(b)
        rooms |= 1 << left
    return bins


def _gifts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All sums of one or two of ``sizes``, ascending, and their sizes (0: none).
    Equal sizes count once, or as a pair where there are two."""
    single, many = np.unique(sizes, return_counts=True)
    a, b = np.triu_indices(len(single))
    able = (a != b) | (many[a] > 1)
    parts = np.concatenate([np.column_stack([single, np.zeros_like(single)]), np.column_stack([single[a[able]], single[b[able]]])])
    sums = parts.sum(1)
    # Of equal sums the single comes first, and is found last.
    order = np.lexsort((parts[:, 1] == 0, sums))
    return sums[order], parts[order]


def _step(mine: np.ndarray, room: np.ndarray, item: np.ndarray, limit: np.ndarray, least: np.ndarray) -> tuple | None:
    """The step that leaves the least room, then moves most: (target, item, given
    sizes).  ``room``: that of each target bin; ``item``: sizes in the targets,
    ``limit`` and ``least`` the most and least that may come for each."""
    best = None
    single = np.unique(mine)
    at = np.searchsorted(single, room, side="right") - 1
    left = np.where(at >= 0, room - single[np.maximum(at, 0)], np.iinfo(np.int64).max)
    if len(left) and at.max() >= 0:
        moved = np.where(at >= 0, single[np.maximum(at, 0)], 0)
        t = int(np.lexsort((-moved, left))[0])
        best = (int(left[t]), -int(moved[t]), t, -1, (int(single[at[t]]),))
    if best is not None and best[0] == 0 or not len(item):
        return best
    sums, parts = _gifts(mine)
    at = np.searchsorted(sums, limit, side="right") - 1
    given = np.where(at >= 0, sums[np.maximum(at, 0)], 0)
    able = (at >= 0) & (given >= least)
    if able.any():
        left = np.where(able, limit - given, np.iinfo(np.int64).max)
        i = int(np.lexsort((-(given - item), left))[0])
        step = (int(left[i]), -int(given[i] - item[i]), -1, i, tuple(int(v) for v in parts[at[i]] if v))
        if best is None or step[:2] < best[:2]:
            best = step
    return best


def improve(bins: list[list[int]], sizes: np.ndarray, limit: int) -> list[list[int]]:
    """Local search: empty underfull bins, the least filled first, into the others.

    A step moves tokens from the source to a target that holds more afterwards
    than the source did, which raises the sum of squared fills: a piece moves,
    or one or two of the source are exchanged for one.  Of all steps the one that
    leaves its target the least room is taken.  A source that cannot be emptied
    gets its pieces back, and the next one is tried.
    """
    fill = np.array([int(sizes[b].sum()) for b in bins])
    order = [int(b) for b in np.argsort(fill, kind="stable") if fill[b] < limit]
    for source in order:
        others = np.array([b for b in order if b != source and bins[b]], int)
        if not bins[source] or limit * len(others) - int(fill[others].sum()) < fill[source]:
            continue
        undo = {b: list(bins[b]) for b in [source, *others.tolist()]}
        # Items of the targets, and the bin of each.
        item = np.array([i for b in others for i in bins[b]], int)
        home = np.array([b for b in others for _ in bins[b]], int)
        while bins[source]:
            room, mine = limit - fill, bins[source]
            held = sizes[item]
            least = np.maximum(held, held + fill[source] - fill[home]) + 1
            found = _step(sizes[mine], room[others], held, held + room[home], least)
            if found is None:
                break
            _, moved, t, at, given = found
            target = int(others[t]) if at < 0 else int(home[at])
            for size in given:
                i = next(i for i in mine if sizes[i] == size)
                mine.remove(i)
                bins[target].append(i)
                item, home = np.r_[item, i], np.r_[home, target]
            if at >= 0:
                taken = int(item[at])
                bins[target].remove(taken)
                mine.append(taken)
                item, home = np.delete(item, at), np.delete(home, at)
            fill[target] -= moved
            fill[source] += moved
        if bins[source]:
            for b, was in undo.items():
                bins[b] = was
                fill[b] = int(sizes[was].sum())
    return [b for b in bins if b]


def pack_group(pdf: pd.DataFrame, limit: int) -> pd.DataFrame:
    pdf = pdf.sort_values("row", ignore_index=True)
    sizes = pdf["length"].to_numpy()
    bins = improve(best_fit(sizes, limit), sizes, limit)
    sequence, offset, fill = (np.zeros(len(pdf), np.int64) for _ in range(3))
    for number, members in enumerate(bins):
        ends = np.cumsum(sizes[members])
        sequence[members], offset[members], fill[members] = number, ends - sizes[members], ends[-1]
    return pdf.assign(bin=sequence, offset=offset, fill=fill)


def pack(cut: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``cut``: pieces with a column ``length``.  Adds sequence_id and offset."""
    columns = cut.columns
    rows = settle(cut.withColumn("row", F.monotonically_increasing_id()))
    whole = rows.filter(F.col("length") >= length).select(*columns, (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, rest, step = [whole], rows.filter(F.col("length") < length), 0
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    left, bins = rest.count(), None
    while left:
        groups = max(1, -(-left // group))
        packed = settle(
            rest.withColumn("group", F.pmod(F.xxhash64("row", F.lit(step)), F.lit(groups)))
            .groupBy("group")
            .applyInPandas(lambda pdf: pack_group(pdf, length), f"{fields}, group long, bin long, offset long, fill long")
        )
        # Groups and bins stay below 2^31 and 2^20, rounds below 2^8.
        number = F.lit(step).cast("long") * (1 << 51) + F.col("group") * (1 << 20) + F.col("bin")
        numbered = packed.withColumn("sequence_id", number)
        poor = F.col("fill") < POOR * length
        # The first piece of each bin has offset 0.
        made = numbered.filter(F.col("offset") == 0).agg(F.count(F.lit(1)).alias("bins"), F.count_if(poor).alias("poor")).first()
        # A round that saves no bin is the last, as is one of a single group.
        last = groups == 1 or (bins is not None and made["bins"] >= bins) or step == 255
        final = numbered if last else numbered.filter(~poor)
        done.append(final.select(*columns, "sequence_id", "offset"))
        if last:
            break
        rest, bins, step = packed.filter(poor).select(*rows.columns), made["poor"], step + 1
        left = rest.count()
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), tokenizer, length), length)
