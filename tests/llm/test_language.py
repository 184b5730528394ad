import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from casebook.llm import language
from casebook.llm.language import languages


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = languages(docs, held_out()).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_awkward_rows(awkward):
    rows = languages(awkward, held_out()).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.doc_id in (0, 1, 2) or (r.doc_id is None and r.score == 1.0 and r.lang_pred == "und"))


def test_predictions_see_the_text_only(awkward):
    other = awkward.withColumn("lang", F.when(held_out(), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    key = lambda df: sorted((str(r.doc_id), r.lang_pred, r.score) for r in languages(df, held_out()).collect())
    assert key(awkward) == key(other)


def test_nothing_to_learn_from(table):
    rows = languages(table(["some text", None]).withColumn("lang", F.lit(None).cast("string")), held_out()).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0), ("und", 1.0)}
    assert languages(table([]), held_out()).count() == 0


def plain_chances(net, text):
    """The network by loops over windows, filters and places."""
    data = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    total, weight, start = np.zeros(len(net.languages)), 0, 0
    while True:
        window = data[start : start + language.WINDOW]
        size = min(max(len(window), 1), language.WINDOW)
        window = window + [0] * (language.WINDOW - len(window))
        hidden = []
        for w in language.WIDTHS:
            for f in range(language.FILTERS):
                places = range(language.WINDOW - w + 1)
                hidden.append(max(sum(net.filters[w][j][window[p + j]][f] for j in range(w)) for p in places))
        x = np.maximum(np.array(hidden) + net.bias, 0) @ net.weights + net.offset
        chances = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        total, weight = total + size * chances, weight + size
        if start + language.WINDOW >= len(data):
            return total / weight
        start += language.STEP


def test_predictions_equal_plain_convolutions():
    net = language.train(["the cat sat on the mat " * 9, "der hund lag auf dem gras " * 9, "EL GATO " * 30], ["en", "de", "es"])
    texts = ["", "a", "The CAT", "x" * 256, "y" * 257, "der hund und the cat " * 40, "日本語 é " * 60]
    got = language.predict(net, net.tables(), pa.array(texts))
    assert np.allclose(got, [plain_chances(net, t) for t in texts], atol=1e-5)


def test_many_languages_share_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_DOCS", 600)
    names = [f"l{i:03d}" for i in range(300)]
    rows = [(n * 10 + k, f"{name} word {k}", name) for n, name in enumerate(names) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    texts, labels = language.sample(docs, F.lit(True))
    assert sorted(set(labels)) == names and len(labels) == 600
    want = {name: sorted(t for t, l in zip(texts, labels) if l == name) for name in names}
    order = docs.select("lang", "text", F.xxhash64("doc_id").alias("h")).collect()
    for name in names:
        least = sorted((r.h, r.text) for r in order if r.lang == name)[:2]
        assert want[name] == sorted(t for _, t in least)
    assert {r.lang_pred for r in languages(docs, F.lit(False)).collect()} <= set(names)
