import re

import sentencepiece

import corpus_pipeline
from casebook.llm.pieces import default_model
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_duplicates import brute as components
from tests.llm.test_secrets import brute as secret_spans


def test_stages_against_plain_versions(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    columns, seen = docs.columns, {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        rows = {r.doc_id: r for r in docs.collect()}
        assert len(rows) == docs.count()
        if k < 4:
            assert docs.columns == columns
        if name == "quality":
            gone = [labels[i] for i in seen if i in labels and i not in rows]
            stay = [labels[i] for i in rows if i in labels]
            assert gone.count(0) >= 0.9 * len(gone) and stay.count(1) >= 0.9 * len(stay)
        elif name == "near_duplicates":
            assert rows.keys() == {i for i, x in components({i: r.text for i, r in seen.items()}).items() if x[2]}
        elif name == "decontamination":
            assert rows.keys() == {i for i, r in seen.items() if not contaminated(r.text, items)[4]}
        elif name == "secrets":
            assert rows.keys() == seen.keys()
            for i, r in seen.items():
                assert (rows[i].text == r.text) == (not secret_spans(r.text))
                assert not re.search("[0-9a-f]{32}", rows[i].text) and rows[i].n_chars == len(rows[i].text)
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=default_model())
            assert all(rows[i].ids == library.encode(r.text) and rows[i].decoded == r.text for i, r in seen.items())
        if k < 3:
            assert all(rows[i] == seen[i] for i in rows)
        seen = rows


def test_awkward_rows(spark, awkward, table):
    folder = "/root/testdata/sf0.001"
    for docs in (awkward, table([])):
        columns = docs.columns
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = corpus_pipeline.written(stage(spark, docs, folder), name)
            assert k == 4 or docs.columns == columns
        docs.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
