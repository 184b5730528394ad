import json

import pytest

from pyspark.sql import functions as F

from casebook.sources import catalogues
from casebook.operators.indexing import chunk_documents
from casebook.sources.collection import append_collection, open_collection, write_collection
from casebook.sources.documents import load_documents, load_text_pages
from casebook.sources.requests import decode_requests, mark_rejects, read_split, write_split
from casebook.sources.source_map import explode_variant, read_source_map


def test_load_documents_drops_blank(spark, tmp_path):
    rows = [(1, "text", "en", "s", 4), (2, "  \n", "en", "s", 3), (3, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        str(tmp_path / "d")
    )
    assert [r.doc_id for r in load_documents(spark, str(tmp_path / "d")).collect()] == [1]


def test_text_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\f \ftwo")
    pages = load_text_pages(spark, str(tmp_path)).orderBy("page").collect()
    assert [(r.page, r.text) for r in pages] == [(0, "one"), (2, "two")]
    assert pages[0].source.endswith("a.txt")
    chunks = chunk_documents(load_text_pages(spark, str(tmp_path))).orderBy("page").collect()
    assert [(r.page, r.chunk_no, r.text) for r in chunks] == [(0, 0, "one"), (2, 0, "two")]
    assert len({r.chunk_id for r in chunks}) == 2 and len({r.doc_id for r in chunks}) == 1


def test_source_map(spark, tmp_path):
    data = [
        {"id": 1, "sources": [{"A": "u1"}, {"B": "u2"}]},
        {"id": 2, "sources": [{"A": "u1", "C": "u3"}]},
        {"id": 2, "sources": [{"A": "u1"}]},
        {"id": 3, "sources": []},
    ]
    path = tmp_path / "map.json"
    path.write_text(json.dumps(data, indent=1))
    got = sorted(tuple(r) for r in read_source_map(spark, str(path)).collect())
    assert got == [(1, "A", "u1"), (1, "B", "u2"), (2, "A", "u1"), (2, "C", "u3")]


def test_collection_append_adds_only_new(spark, tmp_path):
    def chunks(ids):
        docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id bigint, text string")
        return chunk_documents(docs)

    folder = str(tmp_path)
    far = (1 << 40) + 1
    write_collection(chunks([1, 2]), folder)
    append_collection(chunks([2, far]), folder)
    append_collection(chunks([2, far]), folder)
    assert sorted(r.chunk_id.doc_id for r in open_collection(spark, folder, ["chunk_id"]).collect()) == [1, 2, far]


REQUESTS = [
    (1, '{"question": "q"}'),
    (2, '{"question": "q", "options": {"toneValue": 80}}'),
    (3, '{"question": "q", "options": {"character": "lawyer", "toneValue": 0, "illustrationType": null}}'),
    (4, '{"options": {}}'),
    (5, '{"question": ""}'),
]


@pytest.mark.parametrize(
    "given,tone", [('"55"', 55.0), ('" 12.5 "', 12.5), ('""', 0.0), ("true", 1.0), ("null", None), ('"abc"', "nan"), ('"1d"', "nan"), ("1e1", 10.0)]
)
def test_loose_numbers(spark, given, tone):
    rows = [(1, '{"question": "q", "options": {"toneValue": %s}}' % given)]
    row = decode_requests(spark.createDataFrame(rows, "id int, payload string")).first()
    assert (row.tone != row.tone) if tone == "nan" else row.tone == tone


def test_request_defaults(spark):
    df = decode_requests(spark.createDataFrame(REQUESTS, "id int, payload string"))
    got = {r.id: (r.question, r.character, r.tone, r.illustration) for r in df.collect()}
    assert got[1] == ("q", "normal", 50, "none")
    assert got[2] == ("q", "normal", 80, "none")
    assert got[3] == ("q", "lawyer", 0, None)
    assert got[4][0] is None


def test_reject_split(spark, tmp_path):
    marked = mark_rejects(decode_requests(spark.createDataFrame(REQUESTS, "id int, payload string")))
    folder = str(tmp_path / "split")
    write_split(marked, folder)
    assert sorted(r.id for r in read_split(spark, folder, True).collect()) == [1, 2, 3]
    rejected = read_split(spark, folder, False).collect()
    assert sorted(r.id for r in rejected) == [4, 5]
    assert {(r.status, r.code) for r in rejected} == {(400, "BAD_REQUEST")}


def test_faq_file_keeps_declaration_order(spark, tmp_path):
    side = lambda t: {"text": t, "comic": "c", "poster": "p"}
    faq = {k: {"lawyer": side(k + "L"), "normal": side(k + "N")} for k in ["zeta", "alpha", "default"]}
    path = tmp_path / "faq.json"
    path.write_text(json.dumps(faq, ensure_ascii=False, indent=1))
    entries, default = catalogues.faq_entries(catalogues.read_faq(spark, str(path)))
    assert [e.keyword for e in entries] == ["zeta", "alpha"]
    assert entries[0].lawyer_text == "zetaL" and default.normal_text == "defaultN"


def test_scenarios(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps([{"id": 1, "name": "n", "skills": ["a", "b"], "facts": ["f"], "difficulty": 2}]))
    row = catalogues.read_scenarios(spark, str(path)).select(F.size("skills").alias("n"), "duration").first()
    assert row.n == 2 and row.duration is None


def test_intermediate_tables_are_removed(spark, monkeypatch):
    from casebook import session

    monkeypatch.setattr(session, "_MADE", [])
    kept = session.written(spark.range(3), "kept")
    assert kept.count() == 3 and len(session._MADE) == 1
    path = session._MADE[0]
    assert session.remove_intermediate(spark) == 1 and session.remove_intermediate(spark) == 0
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def test_objects_of_unknown_keys_and_types(spark):
    texts = [
        '{"a": 1, "b": "x", "c": [1, "y", null], "d": {"e": {}}, "f": null, "g": true, "h": 1.50, "": "", "i": 1e400}',
        '{"a": "1", "b": 2}',
        '{"a": "1", "b": 2}',
        "[1, 2]", '"text"', "3", "null", "{}", "", "no json", '{"a": 1, "a": 2}', None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, j string").withColumn("one", F.lit(1))
    got = {(r.id, r.key): (r.kind, r.value) for r in explode_variant(df.where("id > 0"), ["id"], "j").collect()}
    assert got == {(i, k): v for i in (1, 2) for k, v in {"a": ("string", "1"), "b": ("number", "2")}.items()}
    # Repeated rows are one.
    assert explode_variant(df.where("id in (1, 2)"), ["one"], "j").count() == 2
    first = df.withColumn("j", F.replace("j", F.lit(', "i": 1e400'), F.lit("")))
    assert {(r.key, r.kind, r.value) for r in explode_variant(first.where("id = 0"), ["id"], "j").collect()} == {
        ("a", "number", "1"), ("b", "string", "x"), ("c", "array", '[1,"y",null]'), ("d", "object", '{"e":{}}'),
        ("f", "null", None), ("g", "boolean", "true"), ("h", "number", "1.5"), ("", "string", ""),
    }
    assert explode_variant(df.where("id < 0"), ["id"], "j").count() == 0
