import random

import pytest
from pyspark.sql import functions as F

from casebook.llm.line_bitmaps import dropped_lines, first_occurrences, kept_text, line_bitmaps, without_frequent_lines


def key(line):
    stripped = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in stripped)


def brute(rows, least, min_chars=1):
    """(n_lines, n_dropped, kept text) by row; a document is a distinct (id, text)."""
    holders = {}
    for doc in {(d, t or "") for d, t in rows}:
        for line in doc[1].split("\n"):
            holders.setdefault(key(line), set()).add(doc)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < least]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def some_rows(seed):
    rng = random.Random(seed)
    common = ["Home", " home\t", "HOME", "", " ", "é", "É", "Accept cookies", " x", "日本"]
    return [
        (i, "\n".join(rng.choice(common) if rng.random() < 0.6 else f"line {rng.randrange(60)}" for _ in range(rng.randrange(1, 12))))
        for i in range(80)
    ]


@pytest.mark.parametrize("least", [1, 2, 10, 40])
def test_against_brute_force(table, least):
    rows = some_rows(least)
    got = without_frequent_lines(table([t for _, t in rows]), least).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, least)


def test_awkward_rows_and_none(awkward, table):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    for least in (1, 2):
        assert sorted(map(tuple, without_frequent_lines(awkward, least).collect()), key=str) == brute(rows, least)
    empty = without_frequent_lines(table([]))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_lines", "n_dropped", "kept_text"]


def test_first_occurrence_stays(table):
    texts = ["a\nb\na", "b\nc", "A \nd", "c"]
    got = {r.doc_id: (r.k, r.n_dropped) for r in line_bitmaps(table(texts), 2, keep_first=True)
           .select("doc_id", "n_dropped", kept_text(F.col("text"), F.col("bitmap")).alias("k")).collect()}
    assert got == {0: ("a\nb", 1), 1: ("c", 1), 2: ("d", 1), 3: ("", 1)}


def test_long_text_of_many_runs(table):
    """Every second line goes: as many runs as can be, coded and decoded."""
    n = 40_000
    texts = ["\n".join("gone" if i % 2 else f"own {i}" for i in range(n)), "gone"]
    got = {r.doc_id: r for r in line_bitmaps(table(texts), 2).withColumn("k", kept_text(F.col("text"), F.col("bitmap"))).collect()}
    assert got[0].n_dropped == n // 2 and len(got[0].bitmap) == 8 * (n // 2)
    assert got[0].k == "\n".join(f"own {i}" for i in range(0, n, 2))
    assert got[1].k == "" and got[1].n_dropped == 1


def test_a_line_of_every_document_is_many_ranges(spark, documents):
    docs = documents.select("doc_id", F.concat(F.lit("the same line\n"), "text").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = first_occurrences(docs).where("at = 0").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(r["count"] for r in parts) < docs.count()
    assert dropped_lines(docs).where("at = 0").count() == docs.select("doc_id").distinct().count()


def test_bitmaps_are_small_and_plan_has_no_python(documents):
    df = without_frequent_lines(documents)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    marked = line_bitmaps(documents).where("bitmap is not null")
    assert marked.where(F.octet_length("bitmap") > 8 * F.col("n_dropped")).count() == 0
