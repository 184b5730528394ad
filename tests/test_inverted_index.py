"""The inverted index against the scan, and what it does not read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casebook.operators import inverted_index
from casebook.operators.indexing import embed_hashed
from casebook.operators.nearest import nearest
from casebook.plans.answering import index_chunks
from casebook.session import fresh_path

SF = "/root/testdata/sf0.001"
VECTORS = "item_id bigint, vec struct<idx:array<int>, val:array<double>>"


def rows_of(hits):
    return sorted((r.query_id, r["rank"], str(r.item_id), round(r.distance, 6)) for r in hits.collect())


def unit(entries):
    norm = sum(w * w for w in entries.values()) ** 0.5
    keys = sorted(entries)
    return (keys, [entries[b] / norm for b in keys])


def random_items(spark, seed, n=400, buckets=30):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        own = rng.choice(buckets, rng.integers(1, 9), replace=False)
        # Bucket 0 is frequent and light, as a stop word is.
        entries = {int(b): float(rng.integers(1, 5)) for b in own}
        if rng.random() < 0.7:
            entries[0] = 0.5
        rows.append((i, unit(entries)))
    rows += [(1000 + i, rows[3][1]) for i in range(30)]  # ties
    return spark.createDataFrame(rows, VECTORS)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(inverted_index, "BLOCK_POSTINGS", 8)
    monkeypatch.setattr(inverted_index, "PART_ROWS", 50)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("k", [1, 7, 20])
def test_equals_the_scan(spark, small_blocks, seed, k):
    items = random_items(spark, seed)
    queries = items.where("item_id % 9 = 0").withColumnRenamed("item_id", "query_id")
    target = fresh_path(spark, "test-index")
    inverted_index.build(items, target)
    want = nearest(queries, items, 30, k, "cosine").where("distance < 2")
    assert rows_of(inverted_index.search(queries, target, k)) == rows_of(want)


def test_documents_and_what_is_skipped(spark):
    """Chunks under struct ids: the scan's hits."""
    items = index_chunks(spark.read.parquet(f"{SF}/documents.parquet")).select(F.col("chunk_id").alias("item_id"), "vec")
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.xxhash64("item_id").alias("query_id"), F.col("text").alias("question"))
    queries = embed_hashed(asked, "question").select("query_id", "vec")
    target = fresh_path(spark, "test-index")
    inverted_index.build(items, target)
    assert rows_of(inverted_index.search(queries, target)) == rows_of(nearest(queries, items, 1024, 20, "cosine"))


def test_skips_blocks(spark, small_blocks):
    items = random_items(spark, 4, n=3000, buckets=200)
    queries = items.where("item_id % 100 = 0").withColumnRenamed("item_id", "query_id")
    target = fresh_path(spark, "test-index")
    inverted_index.build(items, target)
    share = inverted_index.share_read(queries, target, 5)
    assert 0 < share.read < 0.5 * share.there, share


def test_frequent_buckets_are_many_blocks_and_ranges(spark, small_blocks):
    items = random_items(spark, 3, n=2000)
    target = fresh_path(spark, "test-index")
    inverted_index.build(items, target)
    blocks = spark.read.parquet(f"{target}/blocks")
    assert blocks.where("bucket = 0").count() > 100
    assert blocks.where("n > 8 or n < 1 or size(items) <> n or weights[0] <> top").count() == 0
    assert blocks.select("block").distinct().count() == blocks.count()
    read = blocks.select("bucket", F.explode(F.arrays_zip("items", "weights")).alias("e")).selectExpr("bucket", "e.items", "e.weights")
    numbers = spark.read.parquet(f"{target}/vectors").select("no", "item_id")
    read = read.join(numbers.withColumnRenamed("no", "items"), "items").select("bucket", "item_id", "weights")
    want = inverted_index.vector_entries(items, ["item_id"]).selectExpr("bucket", "item_id", "weight weights")
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, want.collect()))


def test_questions_are_not_broadcast(spark, small_blocks):
    """With broadcast joins off no plan of a search sends a table to all tasks, and none crosses."""
    items = random_items(spark, 5)
    queries = items.where("item_id % 9 = 0").withColumnRenamed("item_id", "query_id")
    target = fresh_path(spark, "test-index")
    inverted_index.build(items, target)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted, blocks, *_ = inverted_index._wanted(queries, target, 5)
        plans = [wanted, inverted_index._read(wanted, blocks), inverted_index.search(queries, target, 5)]
        text = "".join(p._jdf.queryExecution().executedPlan().toString() for p in plans)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastExchange" not in text and "NestedLoop" not in text and "Cartesian" not in text


def test_none_and_nothing(spark, small_blocks):
    target = fresh_path(spark, "test-index")
    inverted_index.build(random_items(spark, 6, n=5).limit(5), target)
    queries = spark.createDataFrame(
        [(1, ([7], [1.0])), (2, None), (3, ([], [])), (None, ([7], [1.0])), (4, ([999], [1.0]))],
        "query_id bigint, vec struct<idx:array<int>, val:array<double>>",
    )
    assert {r.query_id for r in inverted_index.search(queries, target).collect()} <= {1}
    empty = fresh_path(spark, "test-index")
    inverted_index.build(spark.createDataFrame([], VECTORS), empty)
    assert inverted_index.search(queries, empty).count() == 0


def even_items(spark, n=3000, buckets=60):
    """Words spread evenly, so that the first bound skips little."""
    rng = np.random.default_rng(8)
    rows = [(i, unit({int(b): float(rng.random()) + 0.1 for b in rng.choice(buckets, 20, replace=False)})) for i in range(n)]
    return spark.createDataFrame(rows, VECTORS)


def test_few_pairs_leave_a_part(spark, monkeypatch):
    """No table between the steps has a row for each pair of a query and an item it shares a word with."""
    monkeypatch.setattr(inverted_index, "PART_ROWS", 500)
    items, target = even_items(spark), fresh_path(spark, "test-index")
    queries = items.where("item_id % 100 = 0").withColumnRenamed("item_id", "query_id")
    inverted_index.build(items, target)
    sizes, write = {}, inverted_index.written

    def counted(df, name):
        out = write(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(inverted_index, "written", counted)
    assert rows_of(inverted_index.search(queries, target, 5)) == rows_of(nearest(queries, items, 60, 5, "cosine"))
    sizes.pop("wanted", None)
    assert max(sizes.values()) <= 30 * 60, sizes


def test_many_questions_meet_a_part_in_tiles(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(inverted_index, "TILE_QUERIES", 7, raising=False)
    items, target = random_items(spark, 7), fresh_path(spark, "test-index")
    queries = items.where("item_id % 9 = 0").withColumnRenamed("item_id", "query_id")
    inverted_index.build(items, target)
    want = nearest(queries, items, 30, 7, "cosine").where("distance < 2")
    assert rows_of(inverted_index.search(queries, target, 7)) == rows_of(want)
