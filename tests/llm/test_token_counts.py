from collections import Counter

import pytest
import sentencepiece

from casebook.llm.pieces import default_model
from casebook.llm.token_counts import CHANGE, Rollup, counted, token_rollup
from casebook.session import fresh_path

import re


def change(spark, *rows):
    return spark.createDataFrame(rows, CHANGE)


def totals(rollup):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}


def test_deltas(spark):
    rollup = Rollup(spark, fresh_path(spark, "rollup"))
    assert totals(rollup) == {} and rollup.entries().count() == 0
    first = change(spark, (1, "insert", "s", "en", "v1", 10, 100), (2, "insert", "s", "en", "v1", 5, 50), (2, "insert", "s", None, "v2", 6, 50))
    assert rollup.commit("a", first)
    assert totals(rollup) == {("s", "en", "v1"): (2, 15, 150), ("s", None, "v2"): (1, 6, 50)}
    assert not rollup.commit("a", first)
    assert rollup.commit("b", change(spark, (1, "revise", "t", "en", "v1", 7, 70), (2, "delete", None, None, "v2", None, None), (9, "delete", "s", "en", "v1", 1, 1)))
    assert totals(rollup) == {("s", "en", "v1"): (1, 5, 50), ("t", "en", "v1"): (1, 7, 70)}
    # An insert of what is there counts once, one of what is gone counts again.
    assert rollup.commit("c", change(spark, (1, "insert", "t", "en", "v1", 8, 80), (2, "insert", "s", "en", "v2", 3, 30)))
    assert totals(rollup) == {("s", "en", "v1"): (1, 5, 50), ("t", "en", "v1"): (1, 8, 80), ("s", "en", "v2"): (1, 3, 30)}
    assert Rollup(spark, rollup.path).committed() == {"a": 1, "b": 2, "c": 3}


def test_batch_that_died_is_written_over(spark):
    rollup = Rollup(spark, fresh_path(spark, "rollup"))
    rollup.commit("a", change(spark, (1, "insert", "s", "en", "v1", 10, 100)))
    # Tables of batch b without its marker.
    change(spark, (7, "insert", "s", "en", "v1", 99, 99)).selectExpr(
        "source", "lang", "tokenizer", "1L n_docs", "n_tokens", "n_chars"
    ).write.parquet(f"{rollup.path}/deltas/2-b")
    assert totals(rollup) == {("s", "en", "v1"): (1, 10, 100)}
    assert rollup.commit("b", change(spark, (2, "insert", "s", "en", "v1", 1, 1)))
    assert totals(rollup) == {("s", "en", "v1"): (2, 11, 101)}


def test_repeated_and_wrong_changes(spark):
    rollup = Rollup(spark, fresh_path(spark, "rollup"))
    row = (1, "insert", "s", "en", "v1", 10, 100)
    rollup.commit("a", change(spark, row, row, (1, "revise", "s", "en", "v1", 4, 40)))
    assert totals(rollup) == {("s", "en", "v1"): (1, 4, 40)}
    for bad in [(None, "insert", "s", "en", "v1", 1, 1), (1, "upsert", "s", "en", "v1", 1, 1), (1, "insert", "s", "en", None, 1, 1)]:
        with pytest.raises(Exception, match="a change needs"):
            rollup.commit("bad", change(spark, bad))
    assert not rollup.commit("none", change(spark)) or totals(rollup) == {("s", "en", "v1"): (1, 4, 40)}
    with pytest.raises(ValueError):
        rollup.commit("../x", change(spark, row))


def test_the_last_change_of_a_batch_holds(spark):
    rollup = Rollup(spark, fresh_path(spark, "rollup"))
    ordered = lambda *rows: spark.createDataFrame(rows, f"{CHANGE}, seq bigint")
    assert rollup.commit("a", change(spark, *((i, "insert", "s", "en", "v1", 10, 100) for i in range(4))))
    assert rollup.commit("b", ordered(
        (0, "revise", "s", "en", "v1", 7, 70, 1), (0, "delete", None, None, "v1", None, None, 2),  # gone
        (1, "delete", None, None, "v1", None, None, 1), (1, "insert", "t", "en", "v1", 3, 30, 2),  # set again
        (2, "revise", "s", "en", "v1", 5, 50, 9), (2, "delete", None, None, "v1", None, None, 9),  # a tie: gone
        (3, "delete", None, None, "v1", None, None, None), (3, "revise", "s", "en", "v1", 1, 9, 0),  # null comes first
    ))
    assert totals(rollup) == {("t", "en", "v1"): (1, 3, 30), ("s", "en", "v1"): (1, 1, 9)}
    # Without the column all changes of a batch are of one moment.
    assert rollup.commit("c", change(spark, (1, "revise", "t", "en", "v1", 4, 40), (1, "delete", "t", "en", "v1", 4, 40)))
    assert totals(rollup) == {("s", "en", "v1"): (1, 1, 9)}
    nameless = spark.createDataFrame([("s", "en", "v1", 2, 20)] * 2, "source string, lang string, tokenizer string, n_tokens bigint, n_chars bigint")
    assert rollup.commit("d", change(spark), nameless) and not rollup.commit("d", change(spark), nameless)
    assert totals(rollup) == {("s", "en", "v1"): (3, 5, 49)}


def brute(docs, labels):
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    poor = {r.doc_id for r in labels if r.quality == 0}
    toxic = {r.doc_id for r in labels if r.toxic == 1}
    out = {}
    for r in docs:
        if r.doc_id is not None and r.doc_id in toxic:
            continue
        text = r.text or ""
        if r.doc_id is not None and r.doc_id in poor:
            text = re.sub(r"[#$%&*|!]+", "", text)
        total = out.setdefault((r.source, r.lang, "piece_bpe_32k"), Counter())
        total.update(n_docs=1, n_tokens=len(library.encode(text)), n_chars=len(text))
    return {k: (v["n_docs"], v["n_tokens"], v["n_chars"]) for k, v in out.items()}


def test_documents(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in token_rollup(documents, labels).collect()}
    assert got == brute(documents.collect(), labels.collect())


def test_awkward_rows(spark, awkward, table):
    labels = spark.createDataFrame([(3, 0, 0), (4, 1, 1), (None, 0, 1), (5, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in token_rollup(awkward, labels).collect()}
    assert got == brute({(r.doc_id, r.text): r for r in awkward.collect()}.values(), labels.collect())
    assert token_rollup(table([]), labels).count() == 0
    assert counted(table([])).count() == 0
