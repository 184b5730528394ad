import os

import pytest

from casebook.operators.indexing import chunk_documents
from casebook.sources import replacing as R

SCHEMA = "doc_id bigint, page int, text string, lang string"


def files(folder):
    return sorted((d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def content(df):
    return sorted((r.doc_id, r.page, r.chunk_no, r.text, r.lang) for r in df.collect())


def test_replaces_adds_removes_and_leaves_the_rest(spark, tmp_path):
    folder = str(tmp_path / "c")
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    base = [(i, p, f"text {i} {p} " + "word " * 300, "en") for i in range(40) for p in range(2)] + [(50, 0, "  ", "en"), (None, 0, "x", "en")]
    first = R.index_documents(frame(base), folder)
    assert {r.change for r in first.collect()} == {"new"} and first.count() == 41
    assert content(R.open_replacing(spark, folder)) == content(chunk_documents(frame(base).where("doc_id is not null")))

    before = files(folder)
    assert R.index_documents(frame(base[::-1]).repartition(3), folder).count() == 0
    assert files(folder) == before  # the same documents in another order write nothing

    later = [r for r in base if r[0] not in (3, 4, None)]
    later = [(i, p, "short now" if i == 5 and p == 1 else t, "de" if i == 6 else lang) for i, p, t, lang in later] + [(60, 0, "added", "en")]
    changes = {r.doc_id: r.change for r in R.index_documents(frame(later), folder).collect()}
    assert changes == {3: "vanished", 4: "vanished", 5: "changed", 6: "changed", 60: "new"}
    stored = R.open_replacing(spark, folder)
    assert content(stored) == content(chunk_documents(frame(later)))
    assert {r.doc_id for r in stored.where("run = 2").collect()} == {5, 6, 60}
    held = stored.count()
    touched = {d for d, f in set(before) ^ set(files(folder))}
    assert len(touched) <= 5  # other buckets keep their files

    assert R.index_documents(frame([(70, 0, "a part", "en")]), folder, whole=False).first().change == "new"
    assert R.open_replacing(spark, folder).count() == held + 1
    assert {r.change for r in R.index_documents(frame(later), folder, size=500).collect()} == {"changed", "vanished"}
    assert content(R.open_replacing(spark, folder)) == content(chunk_documents(frame(later), size=500))

    assert R.index_documents(frame([]), folder).count() == 40
    assert R.open_replacing(spark, folder).count() == 0 and R.index_documents(frame([]), folder).count() == 0


def test_repeated_rows_and_taken_names(spark, tmp_path):
    folder = str(tmp_path / "c")
    once, twice = [(1, 0, "same", "en")], [(1, 0, "same", "en")] * 2
    R.index_documents(spark.createDataFrame(once, SCHEMA), folder)
    assert R.index_documents(spark.createDataFrame(twice, SCHEMA), folder).first().change == "changed"
    assert R.open_replacing(spark, folder).count() == 2
    with pytest.raises(ValueError):
        R.index_documents(spark.createDataFrame([(1, "t", "d")], "doc_id bigint, text string, digest string"), folder)


def test_an_empty_source(spark, tmp_path):
    folder = str(tmp_path / "c")
    assert R.index_documents(spark.createDataFrame([], SCHEMA), folder).count() == 0
