import numpy as np
import pytest
from pyspark.sql import functions as F

from casebook.llm.neighbour_graph import NEIGHBOURS, nearest, neighbour_graph

SCHEMA = "vec_id long, embedding array<float>, score int, node string"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "n") for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(ids, vectors, q, k=10):
    d = np.sqrt(((vectors - vectors[ids.index(q)]) ** 2).sum(axis=1))
    return [(ids[i], d[i]) for i in sorted(range(len(ids)), key=lambda i: (d[i], ids[i])) if ids[i] != q][:k]


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        x = rng.normal(size=(n, 5)).astype(np.float32).astype(float)
        got = by_query(nearest(frame(spark, x), F.col("vec_id") % 3 == 0).collect())
        want = {q: brute(list(range(n)), x, q) for q in range(0, n, 3)}
        assert {q: [v for v, _ in g] for q, g in got.items()} == {q: [v for v, _ in w] for q, w in want.items() if w}
        for q, g in got.items():
            assert np.allclose([s for _, s in g], [s for _, s in want[q]], rtol=1e-12)


def test_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + 0.5 * rng.normal(size=(3000, 16))).astype(np.float32).astype(float)
    got = by_query(nearest(frame(spark, x), F.col("vec_id") % 50 == 0).collect())
    ids = list(range(3000))
    found = sum(len({v for v, _ in got[q]} & {v for v, _ in brute(ids, x, q)}) for q in range(0, 3000, 50))
    assert found / 600 >= 0.95


def test_a_very_common_vector(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8)).astype(np.float32).astype(float)
    x[100:300] = x[100]
    got = by_query(nearest(frame(spark, x), F.col("vec_id") % 50 == 0).collect())
    assert [v for v, _ in got[150]] == list(range(100, 110))
    assert [v for v, _ in got[100]] == list(range(101, 111))
    ids = list(range(400))
    assert {q: [v for v, _ in g] for q, g in got.items()} == {q: [v for v, _ in brute(ids, x, q)] for q in range(0, 400, 50)}


def test_awkward_rows(spark):
    good = [[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 0]]
    bad = [None, [0, 0, 0], [1, None, 0], [float("nan"), 0, 1], [float("inf"), 0, 1], [], [1, 2]]
    rows = frame(spark, [*good, *bad, [1, 0, 0], [1, 0, 0]], [*range(11), 0, None])
    got = by_query(nearest(rows, F.lit(True)).collect())
    assert {q: [v for v, _ in g] for q, g in got.items()} == {0: [3, 1, 2], 1: [3, 0, 2], 2: [0, 1, 3], 3: [0, 1, 2]}
    assert got[0][0][1] == 1.0 and got[0][1][1] == pytest.approx(2**0.5, abs=1e-15)
    assert nearest(frame(spark, []), F.lit(True)).count() == 0
    assert nearest(frame(spark, bad[:3]), F.lit(True)).count() == 0


@pytest.mark.parametrize("case", ["large", "offset", "tiny", "near copies"])
def test_recall_at_any_scale(spark, case):
    rng = np.random.default_rng(7)
    n, x = 1200, rng.normal(size=(1200, 8))
    if case == "near copies":
        x = rng.normal(size=8) + 1e-5 * x
    x = {"large": 1e5 * x, "offset": 1000 + 0.1 * x, "tiny": 1e-12 * x}.get(case, x).astype(np.float32)
    kept = rng.permutation(n)[:60].tolist()
    nodes = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "node long, vec binary")
    graph = {r.node: set(r.others) for r in neighbour_graph(nodes, "<f4", n).collect()}
    x = x.astype(float)
    found = 0
    for i in kept:
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        # Of equally far ones any counts.
        found += min(NEIGHBOURS, sum(d[j] <= np.sort(d)[NEIGHBOURS - 1] for j in graph[i]))
    assert found / (len(kept) * NEIGHBOURS) >= 0.95


def test_distances_beyond_the_range_of_squares(spark):
    x = [[1e200, 0.0], [1.1e200, 0.0], [3e200, 0.0], [0.0, 1e200], [1e-3, 2.0]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = by_query(nearest(rows, F.col("vec_id") == 0).collect())[0]
    assert [v for v, _ in got] == [1, 4, 3, 2]
    assert np.allclose([s for _, s in got], [1e199, 1e200, 2**0.5 * 1e200, 2e200], rtol=1e-12)
