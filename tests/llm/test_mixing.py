"""Mixing against a plain queue."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from rowmill.llm import mixing
from tests.llm.brute import DOCS


def plain_targets(sizes, weights, budget, epochs):
    full = set()
    while True:
        rest = [s for s in sizes if s not in full]
        level = (budget - sum(epochs * sizes[s] for s in full)) / sum(weights[s] for s in rest) if rest else math.inf
        more = {s for s in rest if level * weights[s] > epochs * sizes[s]}
        if not more:
            return {s: float(epochs * sizes[s]) if s in full else level * weights[s] for s in sizes}
        full |= more


def plain_mix(docs, epochs=mixing.EPOCHS, quantum=mixing.QUANTUM):
    """[(doc_id, size, source, target, taken)]; sources ordered, None last."""
    docs = [(d, len((t or "").split()), s) for d, t, s in docs]
    names = sorted({s for *_, s in docs}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(n for _, n, x in docs if x == s) for s in names}
    target = plain_targets(sizes, {s: 1 + i % 3 for i, s in enumerate(names)}, sum(sizes.values()), epochs)
    packets = []
    for s in names:
        end = 0
        for epoch in range(epochs):
            key = lambda i: (hashlib.md5(f"1:{epoch}:{docs[i][0]}".encode()).hexdigest(), docs[i][0])
            for i in sorted((i for i in range(len(docs)) if docs[i][2] == s), key=key):
                start, n = end, docs[i][1]
                end += n
                step = quantum if start < target[s] < end else max(1, n)
                for at in range(0, n, step):
                    part = min(step, n - at)
                    packets.append(((start + at + part) / target[s], names.index(s), epoch, key(i), at, i, part))
    room, taken = sum(sizes.values()), [0] * len(docs)
    for *_, i, part in sorted(packets):
        taken[i] += min(part, room)
        room -= min(part, room)
    return [(d, n, s, target[s], t) for (d, n, s), t in zip(docs, taken)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in rows], DOCS)


def test_equals_a_plain_queue(spark):
    rows = [(i, "w " * (1 + (i * 37) % 400), ["big", "big", "big", "a", None, "é"][i % 6]) for i in range(120)]
    rows += [(200, "x y z", "tiny"), (201, None, "empty"), (202, " \n", "a"), (203, "long " * 9000, "a")]
    docs = frame(spark, rows).withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    got = mixing.mix(docs).collect()
    want = plain_mix(rows)
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in got) == sorted((d, n, t, k) for d, n, _, t, k in want)
    assert sum(r.taken for r in got) == sum(r.size for r in got)
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= mixing.QUANTUM
    assert all(0 <= r.taken <= mixing.EPOCHS * r.size for r in got)


def test_limits_are_reshared_until_none_is_above(spark):
    # Shares of 1:2:3 put b and c above three times their size one after the other.
    docs = frame(spark, [(1, "w " * 1000, "a"), (2, "w " * 10, "b"), (3, "w " * 100, "c")])
    got = {r.source: (r.target, r.taken) for r in mixing.mix(docs).collect()}
    assert got == {"a": (780.0, 780), "b": (30.0, 30), "c": (300.0, 300)}


def test_repeated_rows_ids_and_nulls(spark):
    docs = frame(spark, [(1, "a b", "s")] * 3 + [(None, "a b c", None), (1, "a", "s")])
    got = mixing.mix(docs).collect()
    assert len(got) == 5 and sum(r.taken for r in got) == 10
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_weights_share_and_packets(spark):
    docs = frame(spark, [(i, "w " * 100, "ab"[i % 2]) for i in range(20)])
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    packets = mixing.queue(docs, weights=weights, share=0.5).collect()
    by = {s: sum(p.taken for p in packets if p.source == s) for s in "ab"}
    assert sum(by.values()) == 1000 and abs(by["a"] - 750) <= mixing.QUANTUM
    assert all(p.taken in (0, p.n_words) for p in packets if p.finish <= 1 or p.finish > 2)
    none = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    assert sum(r.taken for r in mixing.mix(docs, weights=none, share=0.5).collect() if r.source == "b") == 0


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, None, "b")]])
def test_without_words(spark, rows):
    got = mixing.mix(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == [(r[0], 0, 0, 0.0, 0) for r in rows]
