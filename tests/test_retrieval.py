import numpy as np
import pytest
from pyspark.sql import functions as F

from casebook import fixed_values as V
from casebook.functions.vectors import hashed_vector
from casebook.operators.indexing import embed_hashed, embed_with, vector_entries
from casebook.operators import cell_index
from casebook.operators import nearest as module_of_nearest
from casebook.operators.nearest import nearest
from casebook.operators.rerank import format_context, rerank, with_fallback
from casebook.session import fresh_path
from casebook.plans.answering import ask, contexts, index_chunks, search_collection, search_documents

DIM = 8


def frame(spark, name, matrix, ids=None):
    ids = range(len(matrix)) if ids is None else ids
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, matrix)]
    return spark.createDataFrame(rows, f"{name} bigint, vec array<double>")


def brute(q, m, k):
    d = np.round(np.maximum((q**2).sum(1)[:, None] + (m**2).sum(1)[None] - 2 * q @ m.T, 0), 6)
    return {i: [int(j) for j in np.lexsort((np.arange(len(m)), row))[:k]] for i, row in enumerate(d)}


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.item_id)
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, DIM)) * 4
    m = centres[rng.integers(0, 6, 400)] + rng.normal(size=(400, DIM)) * 0.3
    m[100:240] = m[5]  # a third of all items are copies
    q = np.vstack([m[:30], rng.normal(size=(20, DIM)) * 4, np.repeat(m[5:6], 25, axis=0)])
    return q, m


def test_scan_equals_brute_force(spark, data):
    q, m = data
    got = nearest(frame(spark, "query_id", q), frame(spark, "item_id", m), DIM, 20)
    assert ranked(got) == brute(q, m, 20)


def in_tiles(queries, items, dim, k=20, metric="l2"):
    """The form for large query tables, seven queries at a time."""
    return nearest(queries, items, dim, k, metric, max_numbers=7 * dim)


def test_tiles_equal_brute_force(spark, data):
    q, m = data
    got = in_tiles(frame(spark, "query_id", q), frame(spark, "item_id", m), DIM)
    assert ranked(got) == brute(q, m, 20)


def test_many_small_tiles_are_few_jobs(spark, data):
    _, m = data
    rng = np.random.default_rng(8)
    q = rng.normal(size=(350, DIM)) * 4
    spark.sparkContext.setJobGroup("many-tiles", "")
    try:
        got = ranked(in_tiles(frame(spark, "query_id", q), frame(spark, "item_id", m), DIM))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("many-tiles"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == brute(q, m, 20)
    assert jobs < 50  # one for each of the 50 tiles was too slow


@pytest.mark.parametrize("scale, offset", [(1, 0), (1, 1e4), (1e20, 0), (1e-4, 0)])
def test_single_precision_loses_no_neighbour(data, scale, offset):
    _, m = data
    m = m * scale + offset
    best = module_of_nearest.Best(60, 20)
    for at in range(0, len(m), 90):
        part = m[at : at + 90]
        best.look(m[:60], m[:60].astype(np.float32), None, np.arange(at, at + len(part))[:, None], part)
    rows, items, _ = best.rows()
    got = {i: items[rows == i, 0].tolist() for i in range(60)}
    assert got == brute(m[:60], m, 20)


def test_tiles_are_well_filled(spark):
    queries = frame(spark, "query_id", np.random.default_rng(1).normal(size=(1000, DIM)))
    sizes = [len(ids) for ids, _ in module_of_nearest.tiles(queries, DIM, False, 400 * DIM)]
    assert sum(sizes) == 1000 and max(sizes) <= 400 and len(sizes) <= 4


def test_tiles_shuffle_no_copies(spark, data, monkeypatch):
    """What a tile's scan shuffles is its hits: at most k for each query and task."""
    from casebook.operators import nearest as module

    q, m = data
    sizes = []
    scan = module.scan
    monkeypatch.setattr(module, "scan", lambda *a, **b: sizes.append(len(a[1])) or scan(*a, **b))
    for copies in (1, 3):
        sizes.clear()
        items = frame(spark, "item_id", np.vstack([m] * copies))
        got = in_tiles(frame(spark, "query_id", q[:40]), items, DIM, 5)
        assert got.count() == 200
        assert sum(sizes) == len(np.unique(q[:40], axis=0)) and max(sizes) <= 7


def test_large_query_side_takes_cells_with_same_rows(spark, data):
    q, m = data
    queries, items = frame(spark, "query_id", q), frame(spark, "item_id", m)
    got = nearest(queries, items, DIM, 5, max_numbers=10 * DIM)
    assert ranked(got) == brute(q, m, 5)


@pytest.mark.parametrize("pivots,metric", [(3, "l2"), (40, "l2"), (12, "cosine")])
def test_stored_cells_equal_brute_force(spark, data, tmp_path, pivots, metric):
    q, m = data
    queries, items = frame(spark, "query_id", q, range(7, 7 + len(q))), frame(spark, "item_id", m)
    folder = str(tmp_path / "index")
    cell_index.build(items, folder, DIM, metric, pivots)
    want = ranked(nearest(queries, items, DIM, 20, metric))
    assert ranked(cell_index.search(queries, folder, DIM, 20, metric)) == want
    assert ranked(cell_index.search(queries, folder, DIM, 20, metric, max_numbers=DIM)) == want


def test_ties_after_rounding_are_not_pruned(spark):
    # Two cells; the nearest of each differ by less than the rounding.
    m = np.zeros((8, DIM))
    m[:4, 0], m[4:, 0] = 3e-4, -3e-4
    q = np.zeros((1, DIM))
    q[0, 0] = 3e-4
    queries, items = frame(spark, "query_id", q), frame(spark, "item_id", m[::-1])
    want = brute(q, m[::-1], 3)
    folder = fresh_path(spark, "index")
    cell_index.build(items, folder, DIM, pivots=8)
    assert ranked(cell_index.search(queries, folder, DIM, 3, probes=1)) == want == {0: [0, 1, 2]}


def test_stored_cells_read_only_what_they_need(spark, tmp_path):
    rng = np.random.default_rng(8)
    far = np.vstack([rng.normal(size=(50, DIM)) + 100 * i for i in range(10)])
    folder = str(tmp_path / "index")
    cell_index.build(frame(spark, "item_id", far), folder, DIM, pivots=10)
    query = frame(spark, "query_id", far[:1])
    got = cell_index.search(query, folder, DIM, 5)
    assert ranked(got) == brute(far[:1], far, 5)
    one = cell_index.probe(query, folder, DIM, 5, probes=1)
    assert ranked(one) == ranked(got)


def test_probing_follows_its_rule(spark, data):
    q, m = data
    folder = fresh_path(spark, "index")
    cell_index.build(frame(spark, "item_id", m), folder, DIM)
    import hashlib

    first = sorted(range(len(m)), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[: cell_index.pivot_count(len(m))]
    d = lambda a, b: np.round(((a[:, None] - b[None]) ** 2).sum(axis=2), 6)
    cell = d(m, m[first]).argmin(axis=1)
    filled = np.unique(cell)
    near = filled[np.argsort(d(q, m[first])[:, filled], axis=1, kind="stable")[:, :3]]
    want = {}
    for i, row in enumerate(d(q, m)):
        inside = [j for j in np.lexsort((np.arange(len(m)), row)) if cell[j] in near[i]]
        want[i] = [int(j) for j in inside[:10]]
    for most in (1 << 20, 7 * DIM):
        assert ranked(cell_index.probe(frame(spark, "query_id", q), folder, DIM, 10, probes=3, max_numbers=most)) == want
    # Enough probes make it exact.
    assert ranked(cell_index.probe(frame(spark, "query_id", q), folder, DIM, 10, probes=99)) == brute(q, m, 10)


def test_probes_are_chosen_by_measured_recall(spark):
    rng = np.random.default_rng(4)
    m = rng.uniform(size=(2500, 32))
    items, folder = frame(spark, "item_id", m), fresh_path(spark, "index")
    cell_index.build(items, folder, 32)
    queries = frame(spark, "query_id", rng.uniform(size=(400, 32)))
    exact = {(i, x) for i, hits in ranked(nearest(queries, items, 32, 10)).items() for x in hits}

    def recall(**given):
        return len(exact & {(i, x) for i, hits in ranked(cell_index.probe(queries, folder, 32, 10, **given)).items() for x in hits}) / len(exact)

    assert recall() >= 0.9 > recall(probes=8)
    assert cell_index.enough_probes(queries, folder, 32, 10) < cell_index.pivot_count(2500)
    assert cell_index.enough_probes(queries.limit(0), folder, 32) == 50


def test_pivots_follow_the_root_of_the_collection():
    assert [cell_index.pivot_count(n) for n in (0, 1, 400, 10_000, 10**12)] == [1, 1, 20, 100, cell_index.MAX_PIVOTS]


def test_fewer_items_than_k(spark):
    m = np.eye(3, DIM)
    for search in (nearest, in_tiles):
        got = search(frame(spark, "query_id", m), frame(spark, "item_id", m), DIM, 20)
        assert ranked(got) == {0: [0, 1, 2], 1: [1, 0, 2], 2: [2, 0, 1]}


def test_empty_sides(spark):
    none, some = frame(spark, "item_id", []), frame(spark, "query_id", np.eye(2, DIM))
    for search in (nearest, in_tiles):
        assert search(some, none, DIM).count() == 0
    assert nearest(none.toDF("query_id", "vec"), frame(spark, "item_id", np.eye(2, DIM)), DIM).count() == 0


def test_cosine_ignores_length(spark, data):
    q, m = data
    long = m * np.linspace(0.5, 3, len(m))[:, None]
    a = nearest(frame(spark, "query_id", q), frame(spark, "item_id", m), DIM, 10, "cosine")
    b = nearest(frame(spark, "query_id", q), frame(spark, "item_id", long), DIM, 10, "cosine")
    c = in_tiles(frame(spark, "query_id", q), frame(spark, "item_id", long), DIM, 10, "cosine")
    assert ranked(a) == ranked(b) == ranked(c)


def test_hashed_vector(spark):
    df = spark.createDataFrame([("b a b  B, c!",), ("...",)], "text string")
    first, second = [r.v for r in df.select(hashed_vector(F.col("text"), 1 << 20).alias("v")).collect()]
    assert sorted(round(x, 6) for x in first.val) == [round(x / 11**0.5, 6) for x in (1, 1, 3)]
    assert first.idx == sorted(first.idx) and second.idx == [] and second.val == []


def test_entries_have_unit_norm(spark):
    df = spark.createDataFrame([(1, "one two two"), (2, "x")], "id int, text string")
    entries = vector_entries(embed_hashed(df), ["id"])
    norms = {r.id: r.n for r in entries.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()}
    assert norms[1] == pytest.approx(1) and norms[2] == pytest.approx(1)


def test_model_is_built_once_per_task(spark):
    def make():
        calls = []

        def model(texts):
            calls.append(1)
            return [[float(len(t)), float(len(calls))] for t in texts]

        return model

    df = spark.createDataFrame([("a",), ("bbb",)], "text string")
    assert sorted(r.vec[0] for r in embed_with(df, make).collect()) == [1.0, 3.0]


def greedy(q, m, k, lam):
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    sim_q, sim = np.round(unit(m) @ unit(q), 6), np.round(unit(m) @ unit(m).T, 6)
    picked = [int(np.argmax(sim_q))]
    while len(picked) < min(k, len(m)):
        best, at = -np.inf, None
        for i in range(len(m)):
            if i not in picked:
                s = lam * sim_q[i] - (1 - lam) * max(sim[i][j] for j in picked)
                if s > best:
                    best, at = s, i
        picked.append(at)
    return picked


@pytest.mark.parametrize("n,k,lam", [(20, 5, 0.5), (3, 5, 0.5), (20, 20, 0.3), (10, 4, 1.0)])
def test_rerank_is_greedy(spark, n, k, lam):
    rng = np.random.default_rng(n)
    q, m = rng.normal(size=(4, DIM)), rng.normal(size=(4, n, DIM))
    m[:, n // 2] = m[:, 0]  # copies: ties go to the earlier candidate
    rows = [
        (i, [float(x) for x in q[i]], 100 + j, j + 1, [float(x) for x in m[i, j]])
        for i in range(4)
        for j in range(n)
    ]
    df = spark.createDataFrame(
        rows, "query_id bigint, query_vec array<double>, item_id bigint, rank bigint, vec array<double>"
    ).repartition(5)
    got = {}
    for r in rerank(df, DIM, k, lam).orderBy("query_id", "pick").collect():
        got.setdefault(r.query_id, []).append(r.item_id - 100)
    assert got == {i: greedy(q[i], m[i], k, lam) for i in range(4)}


def test_context_text_and_fallback(spark):
    hits = spark.createDataFrame([(1, 2, "second"), (1, 1, "first")], "query_id bigint, rank bigint, text string")
    asked = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    got = {r.query_id: r.context for r in with_fallback(asked, format_context(hits)).collect()}
    assert got[1] == "--- Tài liệu 1 ---\nfirst\n\n--- Tài liệu 2 ---\nsecond\n\n"
    assert got[2] == V.NO_CONTEXT_MESSAGE


def test_search_end_to_end(spark):
    docs = spark.createDataFrame(
        [(1, "gambling fine is five million"), (2, "rent contract in writing"), (3, "..."), (4, "weather is fine")],
        "doc_id bigint, text string",
    )
    questions = spark.createDataFrame(
        [(10, "gambling fine"), (11, "???"), (12, "rent contract")], "query_id bigint, question string"
    )
    found = search_documents(docs, questions, k=1)
    texts = {r.query_id: r.context for r in contexts(questions, found).collect()}
    assert "gambling" in texts[10] and "rent" in texts[12] and texts[11] == V.NO_CONTEXT_MESSAGE
    stored = search_collection(index_chunks(docs), questions, k=1)
    cells = search_documents(docs, questions, k=1, max_numbers=1024)
    assert "rent" in ask(index_chunks(docs), "rent contract").first().context
    assert sorted(stored.collect()) == sorted(found.collect()) == sorted(cells.collect())


def test_search_within_a_language_returns_metadata(spark):
    rows = [(1, 3, "rent contract in writing", "en", "a.pdf"), (2, 0, "rent contract for a year", "vi", "b.pdf")]
    docs = spark.createDataFrame(rows, "doc_id bigint, page bigint, text string, lang string, source string")
    asked = spark.createDataFrame([(1, "rent contract")], "query_id bigint, question string")
    found = search_collection(index_chunks(docs), asked, keep=F.col("lang") == "en", metadata=("lang", "source")).collect()
    assert [(r.item_id.doc_id, r.item_id.page, r.lang, r.source) for r in found] == [(1, 3, "en", "a.pdf")]


def test_any_ids_give_the_same_documents(spark):
    """Small, large, negative and hashed ids; several pages of one document."""
    texts = [f"topic{i} page text number {i} " + "filler words here " * 90 for i in range(6)]
    questions = spark.createDataFrame([(i, f"topic{i}") for i in range(6)], "query_id bigint, question string")
    for ids in (range(6), [1 + (i << 40) for i in range(6)], [-(1 << 62) + i for i in range(6)], [5] * 6):
        rows = [(int(d), i, t) for i, (d, t) in enumerate(zip(ids, texts))]
        docs = spark.createDataFrame(rows, "doc_id bigint, page bigint, text string")
        for most in (1 << 22, 1024):
            found = search_documents(docs, questions, k=1, max_numbers=most).collect()
            assert {r.query_id: r.text.split()[0] for r in found} == {i: f"topic{i}" for i in range(6)}
            assert {r.query_id: (r.item_id.doc_id, r.item_id.page) for r in found} == {i: (ids[i], i) for i in range(6)}


def test_tool_messages_with_large_conversation_ids(spark):
    from casebook.plans.answering import tool_messages

    docs = spark.createDataFrame([(1, "fines for gambling"), (2, "rent contracts")], "doc_id bigint, text string")
    rows = [(1, 1, "user", "gambling?"), ((1 << 40) + 1, 1, "user", "rent?"), (1, 1 << 24, "user", "rent?")]
    log = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = tool_messages(log, docs, [("retrieve", ".")]).collect()
    assert len(got) == 3
    assert {(r.conv_id, r.turn): "gambling" in r.content.split(chr(10))[1] for r in got} == {
        (1, 1): True, ((1 << 40) + 1, 1): False, (1, 1 << 24): False
    }


def test_rerank_is_subset_of_nearest(spark):
    from casebook.plans import inputs

    queries, items = inputs.vectors(spark, "/root/testdata/sf0.001")
    hits = nearest(queries, items, inputs.VECTOR_DIM).cache()
    candidates = hits.join(items, "item_id").join(queries.toDF("query_id", "query_vec"), "query_id")
    picked = rerank(candidates, inputs.VECTOR_DIM)
    assert picked.join(hits, ["query_id", "item_id"], "left_anti").count() == 0
    assert picked.groupBy("query_id").count().filter("count <> 5").count() == 0
    firsts = picked.filter("pick = 1").join(hits.filter("rank = 1"), ["query_id", "item_id"])
    assert firsts.count() == queries.count()


@pytest.mark.parametrize("find", [cell_index.search, cell_index.probe])
def test_first_cells_bound_what_the_others_return(spark, tmp_path, monkeypatch, find):
    """Cells after the first ones give only hits within reach, not the best of each task for each query."""
    m = np.random.default_rng(12).normal(size=(600, DIM))
    target, calls, scan = str(tmp_path / "cells"), [], cell_index.scan
    cell_index.build(frame(spark, "item_id", m), target, DIM)
    queries = frame(spark, "query_id", m[:60])

    def kept(*a, **b):
        hits = scan(*a, **b)
        calls.append(sorted((r.query_id, r.distance) for r in hits.collect()))
        return hits

    monkeypatch.setattr(cell_index, "scan", kept)
    got = {}
    for r in find(queries, target, DIM, 5, probes=12).collect() if find is cell_index.probe else find(queries, target, DIM, 5).collect():
        got.setdefault(r.query_id, []).append((r.distance, r.item_id))
    assert all(len(x) == 5 for x in got.values()) and len(got) == 60 and len(calls) == 2
    k_th = {i: sorted(d for q, d in calls[0] if q == i)[4] for i in range(60) if sum(q == i for q, _ in calls[0]) >= 5}
    assert k_th and calls[1] and all(d <= k_th.get(q, np.inf) for q, d in calls[1])


def test_queries_times_cells_do_not_lie_in_the_driver(spark, tmp_path, monkeypatch):
    """Distances to the pivots are taken for a part of the queries at a time, and routes are bits."""
    import tracemalloc

    m = np.random.default_rng(21).normal(size=(3000, DIM))
    target = str(tmp_path / "cells")
    cell_index.build(frame(spark, "item_id", m), target, DIM, pivots=300)
    monkeypatch.setattr(cell_index, "MAX_ROUTED", 50_000, raising=False)
    queries = frame(spark, "query_id", m).repartition(4)
    tracemalloc.start()
    try:
        hits = cell_index.search(queries, target, DIM, 5)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 8 * 3000 * 300  # one matrix of all distances
    assert ranked(hits) == brute(m, m, 5)
