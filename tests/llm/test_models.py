import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import quality_classifier as quality
from helixframe.llm import toxicity
from helixframe.llm.common import id_remainder

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))


@pytest.fixture(scope="module")
def models(tables):
    docs, labels = tables
    return quality.fit_quality(docs, labels, id_remainder("doc_id", 4) != 2), toxicity.fit_toxicity(docs, labels, id_remainder("doc_id", 5) != 0)


def balanced(rows, threshold):
    right = [[(r["score"] >= threshold) == bool(r["y"]) for r in rows if r["y"] == y] for y in (0, 1)]
    return sum(sum(x) / len(x) for x in right) / 2


def test_held_out_accuracy(tables, models):
    docs, labels = tables
    for model, score, label, fold, threshold in (
        (models[0], quality.score_quality, "quality", id_remainder("doc_id", 4) == 2, 0.7),
        (models[1], toxicity.score_toxicity, "toxic", id_remainder("doc_id", 5) == 0, 0.5),
    ):
        rows = score(docs, model).join(labels, "doc_id").where(fold).select("score", F.col(label).alias("y")).collect()
        assert len(rows) > 30 and balanced(rows, threshold) > 0.8


def test_scores_of_edge_cases(models, edge, clashing):
    for model, score in ((models[0], quality.score_quality), (models[1], toxicity.score_toxicity)):
        for df in (edge, clashing):
            rows = score(df, model).collect()
            assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)
            by = {}
            for r in rows:
                by.setdefault(r["doc_id"], set()).add(r["score"])
            assert by[1] == by[2] and len(by[6]) == 1
        assert score(edge.limit(0), model).collect() == []
    assert quality.keep_quality(clashing, models[0], 0.0).columns == clashing.columns
    assert quality.keep_quality(clashing, models[0], 0.0).count() == clashing.count()


def test_held_out_labels_do_not_matter(spark, tables):
    docs, labels = tables
    fold = id_remainder("doc_id", 4) != 2
    flipped = labels.withColumn("quality", F.when(fold, F.col("quality")).otherwise(1 - F.col("quality")))
    scores = lambda given: {r["doc_id"]: r["score"] for r in quality.score_quality(docs, quality.fit_quality(docs, given, fold)).collect()}
    assert scores(labels) == pytest.approx(scores(flipped), abs=1e-6)


def test_without_labels_of_both_classes(spark, docs):
    schema = "doc_id long, quality int, toxic int"
    none, ones = spark.createDataFrame([], schema), spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, None, None), (None, 0, 0)], schema)
    for labels, q, t in ((none, 0.5, 0.0), (ones, 1.0, 1.0)):
        assert quality.fit_quality(docs, labels, F.lit(True)) == q and toxicity.fit_toxicity(docs, labels, F.lit(True)) == t
    assert {r["score"] for r in quality.score_quality(docs, 0.5).collect()} == {0.5}
    for constant in (0.0, 0.5, 1.0):  # nothing was learnt that could reject a document
        assert quality.keep_quality(docs, constant).count() == docs.count()


def test_chunks_of_long_texts_give_the_same_grams(monkeypatch):
    text = "abcdefghij " * 50
    whole = sorted(np.concatenate(list(toxicity.gram_buckets(text))).tolist())
    monkeypatch.setattr(toxicity, "_CHUNK", 37)
    assert sorted(np.concatenate(list(toxicity.gram_buckets(text))).tolist()) == whole
    assert len(whole) == sum(len(f" {text.strip()} ") - n + 1 for n in toxicity.ORDERS)


def test_calibration_on_noisy_labels():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2 * quality.WIDTH + 4))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    model = quality.train_network(x[:3000], y[:3000], np.zeros((1, 1)), 1)
    p = model.scores(x[3000:])
    for low in (0.1, 0.3, 0.5, 0.7):
        part = (p >= low) & (p < low + 0.2)
        assert abs(y[3000:][part].mean() - p[part].mean()) < 0.12


def test_texts_that_are_not_utf8(spark, models):
    df = spark.sql("select * from values (1L, cast(unhex('61FF62') as string)), (2L, cast(unhex('61EFBFBD62') as string)) as t(doc_id, text)")
    for score, model in ((quality.score_quality, models[0]), (toxicity.score_toxicity, models[1])):
        assert len({r["score"] for r in score(df, model).collect()}) == 1
    assert quality.keep_quality(df, models[0], 0.0).count() == 2


def test_repeated_identifiers_do_not_enlarge_the_sample(spark, labels):
    from helixframe.llm.common import labelled_texts

    some = [r["doc_id"] for r in labels.where("doc_id is not null and quality is not null").limit(3).collect()]
    df = spark.createDataFrame([(i, f"text {n}", "x") for i in some for n in range(200)], "doc_id long, text string, label string")
    got = labelled_texts(df, labels, "quality", F.lit(True), 8000).collect()
    again = labelled_texts(df.repartition(5, "text"), labels, "quality", F.lit(True), 8000).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(some) and sorted(map(tuple, got)) == sorted(map(tuple, again))
