import re

from rowmill.llm import decontaminate as D
from rowmill.llm.catalog import QUERIES

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
QUESTION = "So Anna buys 3 apples and Ben buys 5 kg of pears while the shop of Anna closes in 3 hours today."


def test_query_finds_every_whole_item(spark, sf):
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    docs = {r["doc_id"]: plain(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: plain(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op3_benchmark_decontamination"](spark, sf).collect()}
    assert got == want and want


def test_slots_edges_and_repeats(spark):
    like = "noise text. So Carl buys 7 apples and Dora buys 9 kg of pears while the shop of Carl closes in 7 hours today. more"
    docs = [
        (1, QUESTION),
        (2, like),
        (3, like.replace("of Carl", "of Emil")),
        (4, like.replace("closes in 7", "closes in 8")),
        (5, None),
        (6, ""),
        (7, "unrelated " * 50_000 + QUESTION),
        (8, QUESTION.upper()),
        (9, f"{QUESTION} and again {QUESTION}"),
        (1, QUESTION),
        (None, QUESTION),
        (10, "So Anna buys 3 apples"),
    ]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS + ", item_id int, row string")
    got = D.leaks(df, spark.createDataFrame([(9, QUESTION), (8, "too short"), (7, None)], ITEMS)).collect()
    told = sorted((str(r["doc_id"]), r["item_id"], r["exact"]) for r in got)
    assert told == sorted([("1", 9, True), ("1", 9, True), ("2", 9, False), ("7", 9, True), ("9", 9, True), ("None", 9, True)]) or told == sorted(
        [("1", 9, True), ("1", 9, True), ("2", 9, False), ("7", 9, True), ("8", 9, True), ("9", 9, True), ("None", 9, True)]
    )
    assert all(r["coverage"] >= D.COVERAGE for r in got)


def test_slots_do_not_veto_copies(spark):
    item = QUESTION.replace("in 3 hours", "in 4 hours")
    listed = "The list of the values is 3.5 4.5 5.5 6.5 7.5 8.5 9.5 2.5 and their mean is asked for by the teacher of Anna."
    docs = [
        (1, 1, item.replace("3 apples", "7 apples").replace("4 hours", "7 hours").replace("Ben", "Emil")),
        (2, 2, QUESTION.replace("closes in 3", "closes in 8")),
        (3, 2, QUESTION.replace("Anna", "Carl").replace("and Ben", "and so Ben").replace("3", "7")),
        (4, 3, listed.replace("6.5", "x 6.5")),
        (5, 3, listed.replace("values is", "values is about")),
    ]
    items = spark.createDataFrame([(1, item), (2, QUESTION), (3, listed)], ITEMS)
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(spark.createDataFrame([(d, t) for d, _, t in docs], DOCS), items).collect()}
    assert {(d, i) for d, i, _ in docs} <= got


def test_short_items(spark):
    items = [(1, "Who wrote Emma?"), (2, "Yes"), (3, "Ben has 3 kg"), (4, "a b c d e f g"), (5, ""), (6, None), (7, "Who wrote Persuasion?")]
    docs = [(1, "noise: who wrote Emma, who wrote EMMA"), (2, "yes"), (3, "now Ben has 3kg of a b c d e f g h"), (4, "who wrote"), (5, "Ben has 4 kg"), (6, None)]
    got = D.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    told = sorted((r["doc_id"], r["item_id"], r["coverage"], r["first_word"], r["exact"]) for r in got)
    assert told == [(1, 1, 1.0, 1, True), (2, 2, 1.0, 0, True), (3, 3, 1.0, 1, True), (3, 4, 1.0, 6, True)]


def test_empty_tables(spark):
    none, item = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, QUESTION)], ITEMS)
    assert D.leaks(none, item).count() == 0
    assert D.leaks(spark.createDataFrame([(1, QUESTION)], DOCS), item.limit(0)).count() == 0
