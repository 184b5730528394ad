import numpy as np
from pyspark.sql import functions as F

from casebook.llm.quality import STATISTICS, good_documents, held_out, isotonic, quality_scores, statistics

LABELS = "doc_id long, quality int, toxic int, score int"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_scores(docs, labels, held_out()).where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 800
    good, poor = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([r.predicted for r in good]) > 0.98
    assert np.mean([r.predicted for r in poor]) < 0.1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_scores_see_the_text_only(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    key = lambda d, l: sorted((r.doc_id, r.score) for r in quality_scores(d, l, held_out()).collect())  # noqa: E731,E741
    other = documents.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string"))
    hidden = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert key(documents, labels) == key(other, hidden)


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(3, 1, 0, 0), (3, 1, 0, 0), (4, 0, 1, 0), (5, 1, None, 0), (7, 0, 0, 0), (None, 1, 0, 0), (8, None, 0, 0), (99, 1, 0, 0)], LABELS)
    rows = quality_scores(awkward, labels, held_out()).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    kept = good_documents(awkward, labels, held_out())
    assert kept.schema == awkward.schema and kept.count() == sum(r.predicted for r in rows)


def test_without_labels_and_without_documents(spark, awkward, table):
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality_scores(awkward, none, held_out()).collect()} == {0.5}
    assert good_documents(awkward, none, held_out()).count() == awkward.count()
    some = spark.createDataFrame([(1, 1, 0, 0)], LABELS)
    assert quality_scores(table([]), some, held_out()).count() == 0
    assert good_documents(table([]), some, held_out()).count() == 0


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(2)
    y, w = rng.random(7), rng.integers(1, 5, 7).astype(float)
    fit = isotonic(y, w)
    assert (np.diff(fit) >= 0).all()
    loss = (w * (fit - y) ** 2).sum()
    for _ in range(3000):
        other = np.sort(fit + rng.normal(0, 0.1, 7))
        assert (w * (other - y) ** 2).sum() >= loss - 1e-12


def test_statistics():
    assert len(statistics(b"a b\nc")) == len(statistics(b"")) == STATISTICS
    assert np.isfinite(statistics(b"\xff" * 1000)).all() and np.isfinite(statistics(b" \n ")).all()
