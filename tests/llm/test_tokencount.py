import random

import public_tokenizers as P
import pytest

from rowmill.llm import tokencount as T
from rowmill.llm.catalog import QUERIES
from rowmill.llm.queries_tokencount import cleaning_edits

RANKS = P.path("byte_bpe_50k.tiktoken")


def edited(text, edits):
    out, at = "", 0
    for a, b, x in edits:
        out, at = out + text[at:a] + x, b
    return out + text[at:]


def test_any_edits_give_the_count_of_the_edited_text():
    count = T.Counter(RANKS, P.PATTERN)
    rnd = random.Random(1)
    parts = [" ", "  ", "\n", "\n\n", " \n", "a", "é", "12", "'s", ".", "!!", "x y", "漢", "\t", " ", "the ", "word ", ""]
    for _ in range(1500):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 300)))
        leaves = T.cut(text, rnd.choice([1, 4, 64]))
        assert "".join(leaves) == text
        tree = T.Tree(list(leaves), [count(x) for x in leaves], count)
        assert tree.total == count(text)
        cuts = sorted(rnd.choices(range(len(text) + 1), k=2 * rnd.randint(0, 4)))
        edits = [(a, b, "".join(rnd.choices(parts, k=rnd.randint(0, 3)))) for a, b in zip(cuts[::2], cuts[1::2])]
        if len({a for a, _, _ in edits}) < len(edits):
            continue
        tree.edit_all(edits)
        assert "".join(tree.leaves) == edited(text, edits) and tree.total == count(edited(text, edits))


def test_little_is_encoded_again():
    count = T.Counter(RANKS, P.PATTERN)
    text = "some words that go on and on. " * 10_000
    leaves = T.cut(text)
    tree = T.Tree(leaves, [count(x) for x in leaves], count)
    tree.edit_all([(150_000, 150_004, "other")])
    assert tree.encoded < 4 * T.LEAF and tree.total == count(text[:150_000] + "other" + text[150_004:])


def test_query_against_full_encoding(spark, sf):
    count = T.Counter(RANKS, P.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op1_token_counts"](spark, sf).collect()
    assert len(got) == len(texts) and any(r["n_edits"] for r in got)
    for r in got:
        text = texts[r["doc_id"]]
        new = edited(text, cleaning_edits(text))
        assert (r["n_tokens"], r["n_tokens_edited"], r["n_chars_edited"]) == (count(text), count(new), len(new))


def test_edit_column_edges_and_refusals(spark):
    schema = "doc_id long, text string, n_tokens string"
    df = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "one two", "x"), (2, "y" * 200_000, "x")], schema)
    trees = T.build(df, RANKS, P.PATTERN)
    kind = "array<struct<start:int,end:int,text:string>>"
    edits = trees.selectExpr("*", f"cast(case when doc_id = 1 then array(named_struct('start', 0, 'end', 0, 'text', 'hi')) end as {kind}) as edits")
    got = sorted((tuple(r)[:5] for r in T.recount(edits, "edits", RANKS, P.PATTERN).collect()), key=str)
    assert [g for g in got if g[0] == 1] == [(1, 0, 1, 1, 2)] * 2
    assert [g[2:] for g in got if g[0] is None] == [(0, 2, 7)]
    with pytest.raises(ValueError):
        T.Tree(["abc"], [1], len).edit_all([(0, 2, ""), (1, 3, "")])
    empty = T.build(df.limit(0), RANKS, P.PATTERN)
    assert T.recount(empty, cleaning_edits, RANKS, P.PATTERN).count() == 0
