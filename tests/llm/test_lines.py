import random

from rowmill.llm.lines import dedup_lines
from tests.llm.brute import cut_lines, without_lines

SCHEMA = "doc_id long, text string"


def check(spark, docs, **kw):
    df = spark.createDataFrame(docs, SCHEMA)
    got = {r["doc_id"]: r for r in dedup_lines(df, cut="cut", **kw).collect()}
    want = cut_lines(docs, **kw)
    for d, text in docs:
        assert set(got[d]["cut"] or []) == want[d], d
        assert got[d]["text"] == (without_lines(text, want[d]) if want[d] else text)


def test_against_brute_force(spark):
    rnd = random.Random(5)
    lines = [f"line {i}" for i in range(6)] + ["", "  ", "long " * 60, "half " * 30]
    docs = [(d, "\n".join(rnd.choices(lines, k=rnd.randint(0, 14)))) for d in range(120)]
    check(spark, docs)
    check(spark, docs, run_lines=2, run_words=8)


def test_runs_and_edges(spark):
    run = "alpha one\nbeta two\ngamma three\ndelta four"
    docs = [
        (1, f"start\n{run}\nend"),
        (2, f"{run}\nother end"),
        (3, "alpha one\nbeta two"),
        (4, run),
        (5, None),
        (6, ""),
        (7, "same\n" * 400),
        (8, "word " * 60),
        (9, "word " * 60 + "\ntail"),
        (10, "a\n" + "x" * 300_000),
    ]
    check(spark, docs)
    df = spark.createDataFrame([(*d, "keep", 1) for d in docs], SCHEMA + ", cut string, text_hash int")
    got = {r["doc_id"]: r for r in dedup_lines(df).collect()}
    assert got[2]["text"] == "other end" and got[4]["text"] == "" and got[3]["text"] == docs[2][1]
    assert got[7]["text"].strip() == "same" and got[9]["text"] == "tail"
    assert got[5]["text"] is None and got[1]["cut"] == "keep" and got[1]["text_hash"] == 1


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "a b\nc d\ne f"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], SCHEMA)
    got = sorted((str(r["doc_id"]), r["text"]) for r in dedup_lines(df).collect())
    # The NULL id comes first, so its lines stand.
    assert got == [("1", ""), ("1", ""), ("2", ""), ("None", text)]
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
