"""Collocations against plain counting."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowmill.llm import collocations as C
from tests.llm.brute import ASCII_LOWER, DOCS


def plain(docs, least=10, limit=2000, inside=50):
    """[(lang, rank, phrase, a, l, r, n, score)]; ``docs``: (text, lang)."""
    counts, total = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(ASCII_LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for size in (1, 2, 3):
                counts.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    struck = set()
    for p, a in counts.items():
        if len(p) == 4 and a >= least:
            struck |= {q for q in ((p[0], *p[1:3]), (p[0], *p[2:])) if 100 * a >= inside * counts[q]}
    found = {}
    for p, a in counts.items():
        if len(p) > 2 and a >= least and p not in struck:
            cuts = []
            for k in range(1, len(p) - 1):
                left, right = counts[p[: k + 1]], counts[(p[0], *p[k + 1 :])]
                cuts.append((10**6 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            found.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return [
        (lang, i, key.decode(), -a, left, right, total[lang], -score)
        for lang, rows in found.items()
        for i, (score, a, key, left, right) in enumerate(sorted(rows)[:limit], 1)
    ]


def mined(spark, docs, **options):
    df = spark.createDataFrame([(i, t, g, "s", 0) for i, (t, g) in enumerate(docs)], DOCS)
    df = df.withColumn("w", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("score", F.lit(0))
    return sorted(tuple(r) for r in C.collocations(df, **options).collect())


def prose(seed, n=60, vocabulary=25):
    draw = random.Random(seed)
    words = [f"{draw.choice('aéßЖ漢Z')}{i}" for i in range(vocabulary)]
    gap = lambda: draw.choice([" "] * 12 + ["\t", "  ", ", ", ". ", "\n", ";", "!", " \x0b"])
    pick = lambda: words[min(int(draw.expovariate(0.25)), vocabulary - 1)]
    fixed = ["new york city", "machine learning", "Ice Cream", "a b a b a", "x x x x"]
    text = lambda: "".join((draw.choice(fixed) if draw.random() < 0.2 else pick()) + gap() for _ in range(80))
    return [(text(), draw.choice(["en", "en", "fr", None])) for _ in range(n)]


@pytest.mark.parametrize("limit", [1, 3, 20, 2000])
def test_equals_plain_counting(spark, limit):
    docs = prose(limit) + [(None, "en"), ("", None), (" \t. ,", "fr"), ("one", "de"), ("a b", "de")]
    assert mined(spark, docs, limit=limit, min_count=4) == sorted(plain(docs, 4, limit))


def test_floor_is_lowered_until_enough_survive(spark):
    # Each strong pair stands inside a triple that strikes it out; triples of the best pairs score low.
    docs = [(f"p{i} q{i} r{i}", "en") for i in range(30) for _ in range(10 + i % 3)]
    docs += [(f"r{i} z{j}", "en") for i in range(30) for j in range(40)]
    docs += [(f"m{i} n{i}. m{i}. n{i}. " * 3, "en") for i in range(40) for _ in range(4)]
    for limit in (5, 31, 45, 69, 200):
        assert mined(spark, docs, limit=limit) == sorted(plain(docs, 10, limit))


def test_ties_order_by_count_then_bytes(spark):
    docs = [(f"{a} {b}", "en") for a, b in [("z", "é"), ("y", "zz"), ("B", "ab"), ("A", "c")] for _ in range(12)]
    got = mined(spark, docs, limit=2)
    assert [(r[1], r[2], r[7]) for r in got] == [(1, "a c", 10**6), (2, "b ab", 10**6)]


def test_documents_are_apart_and_long_texts_whole(spark, monkeypatch):
    monkeypatch.setattr(C, "SLICE_BYTES", 64)
    docs = [("left", "en"), ("right", "en")] * 30 + [("alpha beta " * 3000, "en"), ("", "en"), ("end", "en")]
    got = mined(spark, docs)
    assert got == sorted(plain(docs))
    assert not any("left" in r[2] for r in got)


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000_000, 3_000_000_000_001, 3_000_000_000_007)], "a long, l long, r long")
    a, left, right = df.first()
    assert df.select(C._score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 10**6 * a * a // (left * right)


def test_no_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(None, None)]) == []


def test_false_hits_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_BITS", 1 << 12)
    monkeypatch.setattr(C, "BITS_PER_KEY", 1)
    docs = prose(8)
    assert mined(spark, docs, limit=10, min_count=4) == sorted(plain(docs, 4, 10))
