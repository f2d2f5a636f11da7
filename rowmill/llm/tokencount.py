"""Edit-aware token counts.

A text is cut into leaves at places no pre-token can span (a single blank
between two other characters), each of at least ``LEAF`` characters.  A segment
tree keeps characters and tokens of every leaf and the sums above them.  An
edit descends to the leaves it touches, widens to those whose boundary
characters it could change, encodes that region alone and updates the sums on
the way up; the rest of the text is never encoded again.

Edits are (start, end, text) in characters of the text as it was; ``end`` is
excluded.  Defined results: a NULL or empty text has no leaves and no tokens;
edits that overlap an earlier one (by start, then order given) or leave the text
raise ValueError; no edits leave the count as it is; rows are counted
separately, repeated or not; an empty table gives no rows; only the named
columns are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 256
_SAFE = re.compile(r"(?<=\S) (?=\S)")

Edit = tuple[int, int, str]


class Counter:
    """Number of tokens of a string; one per task."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self._encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> int:
        return len(self._encoding.encode_ordinary(text))


def cut(text: str, leaf: int = LEAF) -> list[str]:
    out, start = [], 0
    while start < len(text):
        found = _SAFE.search(text, start + leaf)
        end = found.start() if found else len(text)
        out.append(text[start:end])
        start = end
    return out


class Tree:
    """Leaves and a binary tree of sums in heap order (root at 1)."""

    def __init__(self, leaves: list[str], tokens: list[int], count: Callable[[str], int]):
        self.leaves, self._count = leaves, count
        self._half = 1
        while self._half < len(leaves):
            self._half *= 2
        blank = self._half - len(leaves)
        self.chars = [0] * self._half + [len(x) for x in leaves] + [0] * blank
        self.tokens = [0] * self._half + list(tokens) + [0] * blank
        for i in range(self._half - 1, 0, -1):
            self._sum(i)
        self.encoded = 0

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        i = leaf + self._half
        self.chars[i], self.tokens[i] = len(text), tokens
        while i > 1:
            i //= 2
            self._sum(i)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one for the end) and
        its start."""
        i, start = 1, 0
        while i < self._half:
            i *= 2
            if at >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self._half, start

    def edit(self, start: int, end: int, text: str) -> None:
        if not self.leaves:
            self.__init__([""], [0], self._count)
        first, begin = self._find(start)
        last, stop = self._find(max(start, end - 1))
        stop += len(self.leaves[last])
        # A boundary holds while the character before it, its blank and the one after it do.
        while first and start < begin + 2:
            first -= 1
            begin -= len(self.leaves[first])
        while last < len(self.leaves) - 1 and end > stop - 1:
            last += 1
            stop += len(self.leaves[last])
        old = "".join(self.leaves[first : last + 1])
        new = old[: start - begin] + text + old[end - begin :]
        self.encoded += len(new)
        self._set(first, new, self._count(new))
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self._set(leaf, "", 0)

    def edit_all(self, edits: list[Edit]) -> None:
        """From the last to the first, so that places to the left stay."""
        before = sum(map(len, self.leaves))
        for start, end, text in sorted(edits, key=lambda e: e[0], reverse=True):
            if not 0 <= start <= end <= before:
                raise ValueError("edits overlap or leave the text")
            self.edit(start, end, text)
            before = start

    @property
    def total(self) -> int:
        return self.tokens[1] if self.leaves else 0


def build(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, leaf_chars and leaf_tokens: the trees' leaves; the sums
    above follow from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(ranks, pattern)
        for batch in batches:
            leaves = [cut(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text"),
                    pa.array([[len(x) for x in part] for part in leaves], pa.list_(pa.int32())),
                    pa.array([[count(x) for x in part] for part in leaves], pa.list_(pa.int32())),
                ],
                ["doc_id", "text", "leaf_chars", "leaf_tokens"],
            )

    read = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(run, "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>")


def recount(trees: DataFrame, edits: str | Callable[[str], list[Edit]], ranks: str, pattern: str) -> DataFrame:
    """``trees`` as ``build`` gives them; ``edits``: a column with an array of
    structs (start, end, text), or a function of the text that proposes them.
    Per row: doc_id, n_tokens, n_edits, n_tokens_edited, n_chars_edited,
    encoded_chars (encoded again), leaf_chars and leaf_tokens after the edits."""
    names = ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "encoded_chars", "leaf_chars", "leaf_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(ranks, pattern)
        for batch in batches:
            given = None if callable(edits) else batch.column(edits).to_pylist()
            columns: list[list] = [[] for _ in names[1:]]
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "leaf_chars", "leaf_tokens")), strict=True)
            for k, (text, chars, tokens) in enumerate(rows):
                text, at, leaves = text or "", 0, []
                for size in chars:
                    leaves.append(text[at : at + size])
                    at += size
                tree = Tree(leaves, tokens, count)
                made = edits(text) if given is None else [(e["start"], e["end"], e["text"] or "") for e in given[k] or []]
                total = tree.total
                tree.edit_all(made)
                kept = [(len(x), n) for x, n in zip(tree.leaves, tree.tokens[tree._half :], strict=False) if x]
                row = (total, len(made), tree.total, sum(x for x, _ in kept), tree.encoded, [x for x, _ in kept], [n for _, n in kept])
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names
            )

    kinds = ", ".join(f"{n} {'array<int>' if n.startswith('leaf') else 'long'}" for n in names)
    needed = ["doc_id", "text", "leaf_chars", "leaf_tokens"] + ([] if callable(edits) else [edits])
    return trees.select(*needed).mapInArrow(run, kinds)
