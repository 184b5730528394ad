"""Many sparse queries against the dense scan, and what is done once for them."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casebook.functions.vectors import hashed_vector
from casebook.operators import sparse_nearest
from casebook.operators.nearest import nearest
from casebook.plans import answering
from casebook.plans.answering import search_documents

DIM = 600
ITEMS = "item_id struct<a:bigint,b:bigint>, vec struct<idx:array<int>, val:array<double>>"


def random_vectors(n, seed, signs=False):
    """Falling weights of the buckets, as words have them; copies, and rows without any bucket."""
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, DIM + 1)
    rows = []
    for i in range(n):
        own = np.sort(rng.choice(DIM, rng.integers(3, 40), replace=False, p=share / share.sum()))
        weights = rng.integers(1, 6, len(own)) * (rng.choice([-1.0, 1.0], len(own)) if signs else 1.0)
        rows.append(([], []) if i % 97 == 5 else (own.tolist(), weights.tolist()))
    rows[40:70] = [rows[3]] * 30
    return rows


def hits_of(df):
    return sorted((r.query_id, r["rank"], tuple(r.item_id), round(r.distance, 6)) for r in df.collect())


@pytest.fixture
def small_tiles(monkeypatch):
    for name, value in (("TILE_QUERIES", 90), ("ITEM_ROWS", 32), ("QUERY_ROWS", 16), ("FRESH_ROWS", 24), ("FIRST_SHARE", 4)):
        monkeypatch.setattr(sparse_nearest, name, value)


@pytest.mark.parametrize(("n", "k", "signs"), [(700, 20, False), (700, 3, True), (12, 20, False)])
def test_sparse_tiles_equal_the_dense_scan(spark, small_tiles, n, k, signs):
    items = spark.createDataFrame([((i // 7, i % 7), v) for i, v in enumerate(random_vectors(max(n, 71), 1, signs)[:n])], ITEMS)
    asked = [(i, v) for i, v in enumerate(random_vectors(200, 2, signs))]
    queries = spark.createDataFrame(asked, ITEMS.replace("item_id struct<a:bigint,b:bigint>", "query_id bigint"))
    want = nearest(queries, items, DIM, k, "cosine")
    got = nearest(queries, items, DIM, k, "cosine", max_numbers=DIM * 100)
    assert hits_of(got) == hits_of(want) and got.dtypes == want.dtypes


def test_few_pairs_are_measured():
    """Once a query has a bound, a small part of the pairs is gathered."""
    def vectors(n, seed):
        idx, val = zip(*random_vectors(n, seed))
        kinds = pa.list_(pa.int32()), pa.list_(pa.float64())
        return sparse_nearest.Sparse.of(pa.StructArray.from_arrays([pa.array(idx, kinds[0]), pa.array(val, kinds[1])], ["idx", "val"]))

    queries, items = vectors(200, 3), [vectors(512, 10 + i) for i in range(8)]
    tile, gathered = sparse_nearest.Tile(queries, DIM, 5, None), []
    for n, part in enumerate(items):
        add = tile.best.add
        tile.best.add = lambda rows, *a, add=add: (gathered.append(len(rows)), add(rows, *a))
        tile.look(np.arange(512)[:, None] + 512 * n, part)
        tile.best.add = add
        if n == 3:
            gathered.clear()
    assert sum(gathered) < 0.05 * 200 * 512 * 4
    query, item, dist = tile.best.rows()
    v = np.concatenate([part.dense(0, 512, DIM) for part in items])
    all_ = np.round(np.maximum((queries.squares[:, None] + (v * v).sum(1)) - 2 * queries.dense(0, 200, DIM) @ v.T, 0), 6)
    for i in range(200):
        best = np.lexsort((np.arange(len(v)), all_[i]))[:5]
        assert item[query == i, 0].tolist() == best.tolist() and dist[query == i] == pytest.approx(all_[i][best], abs=2e-6)


def test_groups_are_balanced():
    group = sparse_nearest.balanced_groups(np.r_[100.0, 50.0, np.ones(98)], 10)
    assert (group == group[0]).sum() == 1 and (group == group[1]).sum() == 1
    assert np.bincount(group, minlength=10).max() <= 13


def test_many_questions_chunk_the_documents_once(spark, monkeypatch):
    """And their answers are those of the form for few questions, repeated documents included."""
    rows = [(i, f"topic{i} page text number {i} " + f"filler{i % 3} words here " * 90) for i in range(12)]
    docs = spark.createDataFrame([*rows, rows[2], (20, "..."), (21, None)], "doc_id bigint, text string")
    asked = [(i, f"topic{i} filler{i % 3}") for i in range(12)] + [(20, "???")]
    questions = spark.createDataFrame(asked, "query_id bigint, question string")
    calls, chunk = [], answering.chunk_documents
    few = search_documents(docs, questions).collect()
    monkeypatch.setattr(answering, "chunk_documents", lambda *a, **b: (calls.append(1), chunk(*a, **b))[1])
    many = search_documents(docs, questions, max_numbers=5 * 1024).collect()
    assert sorted(map(str, many)) == sorted(map(str, few)) and len(calls) == 1


def test_texts_without_words_or_without_text(spark):
    df = spark.createDataFrame([(0, None), (1, "..."), (2, "b a B ü 中 a_b")], "i int, text string")
    none, empty, some = [r.v for r in df.orderBy("i").select(hashed_vector(F.col("text")).alias("v")).collect()]
    assert none.idx is None and none.val is None and empty.idx == [] and empty.val == []
    # "b" three times, "a" twice, the others once.
    assert sorted(some.val) == pytest.approx([x / 15**0.5 for x in (1, 1, 2, 3)])
