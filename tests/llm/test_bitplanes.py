"""Bit-plane clustering against plain integers."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowmill.llm import bitplanes as B


def plain(rows, k=16, rounds=3, planes=8):
    whole = lambda x: math.floor(64 * x) if abs(x) < 1e300 else 64 * int(x)
    kept = [(i, [whole(x) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    tie = lambda v: B.pack(np.array([v], dtype=object), planes).tobytes()
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), tie(r[1])))
    centres = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    pick = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(rounds):
        where = [pick(v) for _, v in kept]
        for c in range(len(centres)):
            mine = [v for (_, v), w in zip(kept, where) if w == c]
            if mine:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(i, pick(v), far(v, centres[pick(v)])) for i, v in kept], centres


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 70), st.integers(1, 6), st.integers(0, 2**32))
def test_dot_products(bits, n, seed):
    draw = np.random.default_rng(seed)
    top = 1 << (bits - 1)
    big = lambda: int.from_bytes(draw.bytes(10), "little") % (2 * top) - top
    values = np.array([[big() for _ in range(64)] for _ in range(n)], dtype=object)
    typed = values if bits > 62 else values.astype(np.int64)
    packed = B.pack(typed, bits)
    want = [[sum(a * b for a, b in zip(x, y)) for y in values] for x in values]
    assert B.dots(packed, packed).tolist() == want
    assert B.norms(packed).tolist() == [want[i][i] for i in range(n)]


def rows_of(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return df.withColumn("planes", F.lit("clash")).withColumn("cluster", F.lit(-1)).withColumn("id", F.lit(0))


def random_rows(n, spread=1.0, seed=3):
    draw = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in draw.normal(0, spread, 64)]) for i in range(n)]


@pytest.mark.parametrize("n,spread", [(0, 1), (1, 1), (9, 1), (150, 0.3), (60, 1e6), (40, 1e30)])
def test_equals_plain_integers(spark, n, spread):
    rows = random_rows(n, spread)
    bad = [(900, None), (901, [1.0]), (902, [None] * 64), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, [])]
    found = B.cluster(rows_of(spark, rows + bad))
    want, centres = plain(rows)
    assert found.centroids == centres
    got = {r.id: (r.cluster, r.distance) for r in found.assigned.collect()}
    assert got == {i: (c, d if d < 2**63 else None) for i, c, d in want}


def test_doubles_at_the_end_of_their_range(spark):
    rows = [(i, [1.7e308 if j == i else -1.0 for j in range(64)]) for i in range(3)]
    found = B.cluster(rows_of(spark, rows, "double"), k=2)
    assert {r.distance for r in B.digest(found).collect()} <= {0, None}
    assert found.centroids == plain(rows, 2)[1]


def test_ties_repeats_and_null_ids(spark):
    rows = [(1, [0.5] * 64)] * 40 + [(1, [0.25] * 64), (None, [0.75] * 64)]
    found = B.cluster(rows_of(spark, rows), k=3)
    want, centres = plain(rows, 3, planes=7)
    assert found.centroids == centres
    assert sorted((str(r.id), r.cluster, r.distance) for r in found.assigned.collect()) == sorted((str(i), c, d) for i, c, d in want)


def test_digest(spark):
    rows = random_rows(80)
    out = B.digest(B.cluster(rows_of(spark, rows))).collect()
    want, centres = plain(rows)
    per = {}
    for _, c, d in want:
        per[c] = per.get(c, 0) + d
    for r in out:
        text = ",".join(map(str, centres[r.cluster]))
        assert r.cluster_inertia == per[r.cluster] and r.inertia == sum(per.values())
        assert r.centroid_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert B.digest(B.cluster(rows_of(spark, []))).collect() == []
