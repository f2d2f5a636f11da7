from itertools import combinations

from pyspark.sql import functions as F

from rowmill.llm import urls

LABELLED = "url string, block boolean"


def verdicts(spark, pages, labelled=(), **kw):
    df = spark.createDataFrame(pages, "page_id long, url string")
    return {r["page_id"]: r for r in urls.judge(df, spark.createDataFrame(list(labelled), LABELLED), **kw).collect()}


def test_listed_rules_and_edges(spark):
    pages = [
        (1, "http://a.com/x"), (2, "https://EXAMPLE.com/en/1?x=/es/"), (3, "http://www.example.com/en/"), (4, "http://sub.www.example.com/en/z"),
        (5, "http://x.net/fr/1"), (6, "http://x.net/fr"), (7, "http://com"), (8, None), (9, ""), (10, "no scheme"),
        (11, "http://notexample.com/en/"), (12, "x://net/es/#a"), (13, "a://b://c.com/p"), (14, "http://com#/en/"), (14, "http://com#/en/"),
        (15, "http://" + "a" * 50_000 + ".com/"), (16, "http://x.org/es/1"),
    ]
    got = verdicts(spark, pages)
    told = {k: (r["rule"], r["verdict"]) for k, r in got.items()}
    assert told[1] == ("com/", "allow") and told[2] == ("example.com/en/", "block") and told[3] == ("www.example.com/en/", "allow")
    assert told[4] == ("www.example.com/en/", "allow") and told[5] == ("net/fr/", "block") and told[6] == (None, "allow")
    assert told[7] == (None, "allow") and told[8] == (None, "allow") and (got[8]["host"], got[8]["path"]) == ("", "")
    assert told[11] == ("com/", "allow") and told[12] == ("net/es/", "block") and told[15] == ("com/", "allow") and told[16][0] is None
    assert (got[2]["host"], got[2]["path"]) == ("example.com", "/en/1") and (got[13]["host"], got[13]["path"]) == ("b:", "//c.com/p")
    assert (got[14]["host"], got[14]["path"]) == ("com", "")


def labelled():
    out = [(f"http://casino-{i % 3}.example.org/{'win' if i % 2 else 'play'}/{i}", i % 10 != 0) for i in range(60)]
    out += [(f"http://news.example.org/{'win' if i % 5 == 0 else 'read'}/{i}", i % 9 == 0) for i in range(90)]
    return out


def test_mined_rules_against_brute_force(spark):
    mining = urls.Mining(support=0.05, confidence=0.5, lift=1.5)
    rows = labelled()
    df = spark.createDataFrame(rows, LABELLED)
    baskets = [(set(r["t"]), b) for r, (_, b) in zip(df.select(urls.tokens(F.col("url")).alias("t")).collect(), rows)]
    n = len(rows)
    share = {t: sum(t in b for b, _ in baskets) / n for b, _ in baskets for t in b}
    useful = sorted(t for t in share if share[t] <= mining.common)
    prior = sum(b for _, b in baskets) / n
    want = {}
    for size in range(1, len(useful) + 1):
        for items in combinations(useful, size):
            held = [b for x, b in baskets if x.issuperset(items)]
            if held and sum(held) >= mining.support * n and sum(held) / len(held) >= max(mining.confidence, mining.lift * prior):
                want[items] = sum(held) / len(held)
        if size == 6:
            break
    pruned = {k for k, c in want.items() if not any(set(o) < set(k) and want[o] >= c for o in want)}
    got = {tuple(r["items"]): r["confidence"] for r in urls.mine(df, mining).collect()}
    assert set(got) == pruned and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    pages = [(1, "http://casino-1.example.org/win/999"), (2, "http://news.example.org/read/4"), (3, "http://casino-1.example.com/win/9")]
    told = verdicts(spark, pages, rows, mining=mining)
    assert [told[i]["verdict"] for i in (1, 2, 3)] == ["block", "allow", "allow"] and told[3]["rule"] == "com/"


def test_empty_tables_and_extra_columns(spark):
    assert verdicts(spark, []) == {}
    df = spark.createDataFrame([(1, "http://a.org/", "x")], "page_id long, url string, verdict string")
    assert urls.judge(df, spark.createDataFrame([("http://a.org/", None)], LABELLED)).first()["verdict"] == "allow"


def test_rules_where_most_urls_are_blocked(spark):
    rows = [(f"http://bad.example/ads/{i}", True) for i in range(80)] + [(f"http://good.example/text/{i}", False) for i in range(20)]
    mining = urls.Mining(support=0.05, confidence=0.5, lift=1.5, common=1.0)
    mined = urls.mine(spark.createDataFrame(rows, "url string, block boolean"), mining).collect()
    assert mined and all(r["confidence"] == 1.0 for r in mined)
    assert urls.mine(spark.createDataFrame(rows[:80], "url string, block boolean"), mining).count() == 0


def test_long_shared_paths_are_mined_as_one_token(spark):
    path = "/".join(f"{a}{b}" for a in "abcdef" for b in "vwxyz")
    rows = [(f"http://bad.example/{path}", True)] * 40 + [(f"http://good.example/{i}x", False) for i in range(60)]
    got = urls.mine(spark.createDataFrame(rows, LABELLED), urls.Mining(support=0.05)).collect()
    assert {r["items"][0] for r in got} == {f"path:{x}" for x in path.split("/")} | {"host:bad"}
    assert all((r["size"], r["confidence"], r["key"]) == (1, 1.0, r["items"][0]) for r in got)
    # Any of the tokens is enough, as before.
    told = verdicts(spark, [(1, "http://new.example/cx"), (2, "http://new.example/q")], rows, mining=urls.Mining(support=0.05))
    assert told[1]["verdict"] == "block" and told[2]["verdict"] == "allow"
