import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from rowmill.llm import packing
from rowmill.llm.queries_packing import tokenizer

SCHEMA = "doc_id long, text string"


def laid(rows, limit):
    """Sequences must be gapless and not longer than ``limit``."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(by)


def test_ids_of_any_text(spark):
    tok = Tokenizer.from_file(tokenizer())
    tok.encode_special_tokens = True
    rnd = random.Random(7)
    parts = ["the", " ", "\n", "\x85", "\xa0", "É", "e\u0301", "ß", "İ", "'s", "'", "don't", "12", "½", "漢字", "!!", "<|endoftext|>", "\x1c", "ﬁ", "Ⅷ", "_", "a_b", "\u200b", "😀", "Œ"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(1, 30))) for _ in range(400)]
    texts += [p + q for p in parts for q in parts] + [None, "", " ", "word " * 5000]
    cut = packing.pieces(spark.createDataFrame(list(enumerate(texts)), SCHEMA), tokenizer(), 64).collect()
    have = {}
    for r in cut:
        have.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, t in enumerate(texts):
        ids = np.array([*(tok.encode(t, add_special_tokens=False).ids if t else []), 0], "<u4")
        want = [(k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
        assert sorted(have[i]) == want, repr(t)


@pytest.mark.parametrize("group", [40, 3000])
def test_every_piece_once_and_few_sequences(spark, group):
    rnd = random.Random(3)
    sizes = [rnd.choice([rnd.randint(1, 100), rnd.randint(300, 1100), 2048]) for _ in range(900)]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id long, length long, row string").drop("row")
    rows = packing.pack(df, 2048, group).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(sizes))
    assert laid(rows, 2048) <= 1.02 * -(-sum(sizes) // 2048) + 1


def test_local_search_empties_a_bin():
    limit = 100
    sizes = np.array([70, 20, 80, 15, 15])
    bins = [[0, 1], [2], [3, 4]]  # two for one, then a move
    out = packing.improve([list(b) for b in bins], sizes, limit)
    assert len(out) == 2 and sorted(i for b in out for i in b) == list(range(5))
    assert all(sizes[b].sum() <= limit for b in out)
    rnd = np.random.default_rng(0)
    for _ in range(30):
        sizes = rnd.integers(1, 60, 60)
        made = packing.best_fit(sizes, limit)
        better = packing.improve([list(b) for b in made], sizes, limit)
        assert sorted(i for b in better for i in b) == list(range(60)) and len(better) <= len(made)
        assert all(sizes[b].sum() <= limit for b in better)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, "y")], SCHEMA + ", offset string")
    rows = packing.pack_documents(df, tokenizer()).collect()
    assert sorted(r["length"] for r in rows) == [1, 3, 3] and laid(rows, 2048) == 1
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), tokenizer()).count() == 0
