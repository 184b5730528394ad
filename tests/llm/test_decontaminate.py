import hashlib
import re

import pytest

from casebook.llm.decontaminate import contamination, without_contaminated


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    doc, hit, names = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        n = min(len(w), 13)
        if item_id is None or not n:
            continue
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(doc) - n + 1):
            if tuple(doc[i : i + n]) in windows:
                hit.update(range(i, i + n))
                names.add(str(item_id))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(doc), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(doc)


LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [
    (1, LONG),
    (2, "One, Two! three"),
    (10, "one two THREE"),
    (3, None),
    (4, "!!! ..."),
    (None, "x y z"),
    (5, "Éa 日本 ß9 " + " ".join(f"q{i}" for i in range(12))),
    (6, "a a a a a a a a a a a a a a a"),
]
TEXTS = [
    None,
    "",
    "...",
    "zero one two three four",
    "one two",
    LONG.upper(),
    "x " * 700 + LONG[:44] + " y" * 700,
    "pad " * 19 + " ".join(f"w{i}" for i in range(5, 19)) + " pad" * 200,
    " ".join("a" for _ in range(100)),
    "Éa-日本/ß9 " + "_".join(f"Q{i}" for i in range(12)),
    "éa 日本 ß9 " + " ".join(f"q{i}" for i in range(12)),
]


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(*x, "spare") for x in ITEMS], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("max_windows", [300_000, 20])
def test_small(spark, table, items, max_windows):
    got = {r.doc_id: tuple(r)[1:6] for r in contamination(table(TEXTS), items, max_windows).collect()}
    assert got == {i: brute(t, ITEMS) for i, t in enumerate(TEXTS)}
    kept = without_contaminated(table(TEXTS), items, max_windows)
    assert kept.schema == table(TEXTS).schema
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate(TEXTS) if not brute(t, ITEMS)[4]]


def test_spans(spark, table, items):
    row = contamination(table(["zero one two three four one two three"]), items).first()
    assert [tuple(s) for s in row.spans] == [(1, 4), (5, 8)]


def test_documents(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    listed = [(r.item_id, r.text) for r in items.collect()]
    got = {r.doc_id: tuple(r)[1:6] for r in contamination(documents, items).collect()}
    assert got == {r.doc_id: brute(r.text, listed) for r in documents.collect()}
    assert any(v[4] for v in got.values())


def test_awkward_and_empty_tables(spark, awkward, table, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(awkward, items).count() == awkward.count()
    assert not any(r.contaminated for r in contamination(awkward, none).collect())
    assert without_contaminated(awkward, none).count() == awkward.count()
    assert contamination(table([]), items).count() == 0
