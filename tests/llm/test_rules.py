import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rowmill.llm import rules

SCHEMA = "doc_id long, lang string, source string, text string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    where = {}
    for k in range(len(words) - 7):
        where.setdefault(tuple(words[k : k + 8]), []).append(k)
    again = {i for ks in where.values() if len(ks) > 1 for k in ks for i in range(k, k + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_counts_against_brute_force_and_edges(spark):
    rnd = random.Random(2)
    parts = ["a", "bé", "漢", "#", "<|>", "\n", "\n\n", " ", "\t", "\x0b", "\u00a0", "the same eight words stand here once more"]
    texts = [" ".join(rnd.choices(parts, k=rnd.randint(0, 60))) for _ in range(150)] + [None, "", "\n \n", "x " * 100_000, "\u2028 \x85"]
    df = spark.createDataFrame([(i, "en", "s", t, 1) for i, t in enumerate(texts)], SCHEMA + ", kept int")
    got = {r["doc_id"]: r for r in rules.judge(df).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], brute(t)
        assert tuple(r[c] for c in rules.COUNTS) == want, (i, t)
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def clean(rnd, n):
    return ". ".join(" ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 9))) for _ in range(9)).capitalize() for _ in range(n))


def test_outliers_go_and_clean_texts_stay(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(400):
        lang, source = ("en", "a") if i % 3 else (None, "b" if i % 2 else None)
        text = clean(rnd, rnd.randint(3, 40))
        if i % 25 == 0:
            text = " ".join(w + rnd.choice(["%%%", " |", "&&&"]) for w in text.split())
        if i % 25 == 1:
            text = text.upper()
        rows.append((i, lang, source, text))
    got = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 400
    assert all(got[i]["kept"] == (i % 25 > 1) for i in range(400))


def test_estimate_against_numpy(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(2001, rules.DIM)) * [1, 2, 0.5, 1, 3, 1] + 4
    x[:200] += 30
    names = [f"x{i}" for i in range(rules.DIM)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).withColumn("g", F.lit("one"))
    row = rules.estimate(df).first()
    m = np.median(x, 0)
    w = np.linalg.inv(rules.CONSISTENCY * np.diag((1.4826 * np.median(abs(x - m), 0)) ** 2) + np.diag(np.square(rules.FLOOR)))
    for _ in range(rules.STEPS):
        d = np.einsum("ij,jk,ik->i", x - m, w, x - m)
        near = x[d <= np.sort(d)[int(np.ceil(rules.SUPPORT * len(d))) - 1]]
        m = near.mean(0)
        w = np.linalg.inv(rules.CONSISTENCY * np.cov(near.T, bias=True) + np.diag(np.square(rules.FLOOR)))
    assert np.allclose(row["m"], m, atol=0.02) and np.allclose(np.reshape(row["w"], w.shape), w, atol=0.05)


def test_empty_table(spark):
    assert rules.judge(spark.createDataFrame([], SCHEMA)).count() == 0
