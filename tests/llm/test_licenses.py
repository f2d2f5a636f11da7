import random
import re

import duckdb
import pandas as pd

from rowmill.llm import licenses
from rowmill.llm.queries_licenses import SQL
from tests.llm.brute import ASCII_LOWER
from tests.test_oracle import rows

MIT = licenses.NOTICES["mit"][0]


def test_places_labels_and_edges(spark):
    docs = [
        (1, "Released under the MIT License. mit license"),
        (2, "CC BY-NC 4.0; licensed CC-BY"),
        (3, None),
        (4, ""),
        (5, "GNU General Public  Licence"),
        (6, ("filler " * 50_000) + "Apache License"),
        (7, "Mİt license, mit-license"),
        (7, "Mİt license, mit-license"),
        (8, "gnu general public gnu general public license"),
        (9, " ".join(w for i, w in enumerate(MIT.split()) if i % 12 != 5)),
        (10, "copy of this software and associated"),
        (None, "all RIGHTS reserved"),
    ]
    df = spark.createDataFrame([(*d, "x", 9) for d in docs], "doc_id long, text string, labels string, row int")
    got = licenses.scan(df).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(docs)
    phrases = {tuple(p.split()): label for p, label in licenses.BASE_PHRASES.items()}
    for doc, text in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
        r = by[doc]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert r["first_word"] == min((i for i, _ in places), default=None) and r["last_word"] == max((i for i, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert by[2]["labels"] == "cc-by,cc-by-nc"
    assert by[9]["labels"] == "mit" and 0.6 <= by[9]["score"] < 1  # every twelfth word is missing
    assert by[10]["labels"] == "" and by[None]["labels"] == "all-rights-reserved"


def test_notices_in_close_order(spark):
    docs = [
        (1, "all rights reserved all rights reserved", {"all-rights-reserved": [(0, 3), (3, 6)]}),
        (2, "CC BY-NC, CC BY-SA", {"cc-by": [(0, 2), (3, 5)], "cc-by-nc": [(0, 3)], "cc-by-sa": [(3, 6)]}),
        (3, "all rights reserved " * 20_000, {"all-rights-reserved": [(i, i + 3) for i in range(0, 60_000, 3)]}),
        (4, "all rights x all x rights", {}),
    ]
    again = {t.id + 10: t for t in licenses.templates()}
    docs += [(k, " ".join(t.words * 3), None) for k, t in again.items()]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")).collect()}
    for doc, _, want in docs[:4]:
        spans = {}
        for s in got[doc]["spans"] or []:
            spans.setdefault(s["label"], []).append((s["start"], s["end"]))
        assert spans == want and got[doc]["labels"] == ",".join(sorted(want))
        assert got[doc]["score"] == (1.0 if want else 0.0)
    for doc, t in again.items():
        n = len(t.words)
        places = {(s["start"], s["end"]) for s in got[doc]["spans"] if s["label"] == t.label and s["coverage"] == 1.0}
        assert got[doc]["score"] == 1.0 and {(i * n, i * n + n) for i in range(3)} <= places


def test_sql_says_the_same_of_close_notices(spark):
    draw = random.Random(4)
    made = [" ".join(t.words) for t in licenses.templates()]
    words = ["all", "rights", "reserved", "cc", "by", "nc", "sa", "x", *MIT.split()[:12]]
    docs = [(1, "all rights reserved all rights reserved"), (2, "CC BY-NC, CC BY-SA"), (3, MIT + " " + MIT), (4, None), (5, "")]
    docs += [(10 + i, " ".join(draw.choice(made + words * 2) for _ in range(draw.randint(2, 14)))) for i in range(120)]
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).drop("spans").toPandas()
    documents = pd.DataFrame(docs, columns=["doc_id", "text"])
    want = duckdb.sql(SQL).df()
    assert len(documents) == len(want)
    plain = lambda d: rows(d.astype(object).map(lambda v: int(v) if isinstance(v, float) and v.is_integer() else v))
    assert plain(got) == plain(want.astype(object).where(want.notna(), None))
    assert max(len(r["labels"].split(",")) for _, r in got.iterrows()) > 3


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
