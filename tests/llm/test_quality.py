import numpy as np

import corpus_pipeline
from rowmill.llm import quality
from rowmill.llm.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = QUERIES["op9_quality_classifier"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert ((got.score >= 0.7).astype(int) == got.predicted).all()
    held = both[both.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert ((held.predicted == 1) == (held.quality == 1)).mean() > 0.93
    assert (good[:, None] > bad[None, :]).mean() > 0.95


def test_scores_do_not_depend_on_other_columns_and_edges(spark):
    model = quality.learn(spark, SF)
    assert quality.learn(spark, SF).weights == model.weights
    long = "Some clean words that go on. " * 20_000
    rows = [(1, None, "a"), (2, "", "a"), (3, "  \n", "a"), (4, "x", "a"), (5, long, "a"), (4, "x", "b"), (None, "x", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = quality.score(df, model, into="_rm_score").collect()
    assert len(got) == 7 and all(0 <= r["_rm_score"] <= 1 for r in got)
    by = [r["_rm_score"] for r in got]
    assert by[0] == by[1] == by[2] and by[3] == by[5] == by[6] and got[0]["score"] == "a"
    assert quality.score(df.limit(0), model).count() == 0


def test_no_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, True), (None, False)], "doc_id long, good boolean")
    assert quality.train(docs, labels) is None
    assert [r["score"] for r in quality.score(docs, None).collect()] == [0.5, 0.5]


def test_two_labels_of_a_kind_are_enough(spark):
    texts = [(i, f"clean words number {i} go on and on") for i in range(20)] + [(i, f"$$$ buy {i} now !!! $$$") for i in range(20, 40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for k in range(20, 26):
        labels = [(i, True) for i in range(20)] + [(k, False), (k + 1, False)]
        assert quality.train(docs, spark.createDataFrame(labels, "doc_id long, good boolean")) is not None


def test_stage_keeps_all_without_a_model(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (None, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert quality.learn(spark, str(tmp_path)) is None
    assert corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).count() == 3


def test_logistic_separates():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(400, 2))
    y = (x[:, 0] + 0.1 * rnd.normal(size=400) > 0).astype(float)
    p = quality._probability(x, tuple(quality._logistic(x, y, 1e-3)))
    assert ((p > 0.5) == (y == 1)).mean() > 0.95
