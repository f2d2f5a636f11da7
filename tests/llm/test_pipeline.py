"""Each stage on its own input against brute force, and odd tables through all."""

import re

import pytest

import corpus_pipeline as C
from rowmill.functions.storage import settle
from rowmill.llm import quality
from tests.llm.brute import DOCS, components, cut_lines, without_lines


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs)
    for _, stage in C.STAGES:
        docs = settle(stage(spark, docs, sf))
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_stay(steps):
    assert all(df.columns == steps[0].columns for df in steps[:-1])


def test_quality_stage(spark, sf, steps):
    model = quality.learn(spark, sf)
    sizes = quality.Sizes(model.good, model.bad, model.fit)
    value = lambda t: quality._probability(quality._shape(sizes.features(t)[None, :]), model.weights)[0]
    assert texts(steps[1]) == {d: t for d, t in texts(steps[0]).items() if value(t) >= quality.THRESHOLD}


def test_line_stage(steps):
    before = texts(steps[1])
    cuts = cut_lines(list(before.items()))
    want = {d: without_lines(t, cuts[d]) if cuts[d] else t for d, t in before.items()}
    assert texts(steps[2]) == {d: t for d, t in want.items() if t or not before[d]}
    assert all(r["n_chars"] == len(r["text"]) for r in steps[2].collect() if cuts[r["doc_id"]])


def test_near_stage(steps):
    before = texts(steps[2])
    _, root = components(list(before.items()), 5, 80)
    assert set(texts(steps[3])) == {d for d in before if root[d] == d}


def test_benchmark_stage(spark, sf, steps):
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [plain(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = texts(steps[3])
    assert set(texts(steps[4])) == {d for d, t in before.items() if not any(x in plain(t) for x in items)}


def test_packing_stage_and_run(spark, sf, steps):
    assert {r["doc_id"] for r in steps[5].select("doc_id").collect()} == set(texts(steps[4]))
    pieces = lambda df: sorted(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert pieces(C.run(spark, sf)) == pieces(steps[5])


def test_odd_rows_and_clashing_columns(spark, sf):
    rows = [(1, None, None, None, None), (None, "a b c d e f g", None, "s", 3), (2, "", "en", "s", 0), (3, "x " * 50_000, "en", "s", 9), (4, "same text here", "en", "s", 1), (4, "same text here", "en", "s", 1)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], DOCS + ", score int, cut string")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns, name
        assert 0 <= out.count() <= len(rows)
        assert stage(spark, df.limit(0), sf).count() == 0
    assert C.STAGES[-1][1](spark, df, sf).count() >= len(rows)
