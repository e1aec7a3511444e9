import numpy as np
from pyspark.sql import functions as F

from motifline.llm import weaklabels as W


def test_expectation_maximisation_finds_accuracies_of_made_labellers():
    rnd = np.random.default_rng(1)
    true = (rnd.random(40_000) < 0.8).astype(int)
    rates, votes = [0.95, 0.9, 0.8, 0.85, 0.7], []
    for r in rates:
        v = np.where(rnd.random(len(true)) < r, true, 1 - true)
        votes.append(np.where(rnd.random(len(true)) < 0.3, W.NONE, v))
    votes = np.stack(votes, axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = W.fit_labels(patterns, counts, steps=500)
    assert np.abs(model.accuracies() - np.array(rates)).max() < 0.03 and abs(model.prior[W.GOOD] - 0.8) < 0.03
    assert ((model.posterior(votes) >= 0.5) == true).mean() > 0.93


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = W.judged(docs, sample=500).join(labels.withColumnRenamed("quality", "true"), "doc_id").select("quality", "true").collect()
    right = np.array([[r[0], r[1]] for r in rows])
    assert (right[:, 0] == right[:, 1]).mean() > 0.95
    assert right[right[:, 1] == 1, 0].mean() > 0.98


def test_every_row_is_judged_and_good_rows_stay_as_they_are(spark, docs):
    more = docs.withColumn("_score", F.lit("x")).withColumn("quality", F.lit("y")).drop("_text")
    judged = W.judged(more).collect()
    assert len(judged) == more.count()
    by_id = {r.doc_id: r.score for r in judged}
    assert by_id[2] == by_id[3] == by_id[4] == 0.0
    kept = W.keep_good(docs.drop("_text", "pos"))
    assert kept.columns == docs.drop("_text", "pos").columns
    good = [r.doc_id for r in judged if r.quality]
    assert sorted(map(str, good)) == sorted(str(r.doc_id) for r in kept.collect())


def test_empty_table_and_one_row(spark, docs):
    assert W.judged(docs.limit(0)).count() == 0 and W.keep_good(docs.limit(0)).count() == 0
    assert W.judged(docs.where("doc_id = 1")).count() == 1


def test_long_texts_are_counted_whole():
    text = "one two three. " * 20_000
    whole = W.features(text)
    W.TEXT_BYTES, kept = 1 << 20, W.TEXT_BYTES
    try:
        assert np.allclose(whole, W.features(text))
    finally:
        W.TEXT_BYTES = kept
