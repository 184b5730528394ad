"""Exact nearest neighbours of a table of queries in a table of vectors.

The queries are sent to every task as one matrix of bounded size; each task reads
its share of the collection once and keeps only the best ``k`` per query. Nothing of
the collection is shuffled. A query table beyond the bound is cut into tiles, each
of which is one such scan, so no copy of a query or of an item is ever shuffled.

Ids are single columns: a number, or a struct of numbers that compares field by field.

Distances are rounded before ranking and ties go to the smaller id, which makes
the order independent of summation order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.fixed_values import FETCH_K
from casebook.functions.vectors import (
    DIGITS,
    arrow_matrix,
    squared_distances,
    unit_rows,
)
from casebook.operators.ordering import first_k, spread
from casebook.session import fresh_path, written

# A query matrix of at most this many numbers (32 MB) may be sent to every task.
MAX_BROADCAST_NUMBERS = 4_194_304
# Distances held at once by a task, and numbers of vectors of pairs measured at once.
MAX_TILE = 2_000_000
MAX_NUMBERS = 4_000_000
BLOCK_ROWS = 4096
# More than a few query matrices below this many numbers (2 MB) are not worth a job each:
# they meet the items in pairs of blocks.
SMALL_MATRIX, FEW_TILES = 262_144, 8
# Candidates a task gathers before it merges them into its best.
MERGE_ROWS = 200_000
EMPTY = np.zeros(0, np.int64)



def hit_schema(queries: DataFrame, collection: DataFrame) -> str:
    kinds = dict(queries.dtypes)["query_id"], dict(collection.dtypes)["item_id"]
    return "query_id {}, item_id {}, distance double".format(*kinds)


def id_numbers(column: pa.Array) -> np.ndarray:
    """Ids as rows of numbers, one column for each field."""
    fields = column.flatten() if pa.types.is_struct(column.type) else [column]
    return np.stack([f.to_numpy(zero_copy_only=False) for f in fields], axis=1).astype(np.int64)


def id_column(numbers: np.ndarray, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_struct(kind):
        return pa.array(numbers[:, 0], kind)
    fields = [kind.field(i) for i in range(kind.num_fields)]
    return pa.StructArray.from_arrays([pa.array(numbers[:, i], f.type) for i, f in enumerate(fields)], fields=fields)


def _best(query: np.ndarray, item: np.ndarray, dist: np.ndarray, k: int):
    """Keep the ``k`` smallest (distance, item) of each query; items are rows of numbers."""
    order = np.lexsort((*item.T[::-1], dist, query))
    query, item, dist = query[order], item[order], dist[order]
    first = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
    keep = np.arange(len(query)) - start < k
    return query[keep], item[keep], dist[keep]


def _exact(q: np.ndarray, v: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Rounded squared distances of pairs of rows, as ``squared_distances`` gives them."""
    out = np.empty(len(rows))
    step = max(1, MAX_NUMBERS // q.shape[1])
    for at in range(0, len(rows), step):
        x, y = q[rows[at : at + step]], v[cols[at : at + step]]
        total = _squares(x) + _squares(y)
        out[at : at + step] = np.maximum(total - 2.0 * np.einsum("ij,ij->i", x, y), 0.0)
    return np.round(out, DIGITS)


def _squares(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows)


def _all_candidates(q: np.ndarray, v: np.ndarray, k: int, limit: np.ndarray):
    dist = np.round(squared_distances(q, v), DIGITS)
    bound = limit
    if dist.shape[1] > k:
        bound = np.minimum(limit, np.partition(dist, k - 1, axis=1)[:, k - 1])
    rows, cols = np.nonzero(dist <= bound[:, None])
    return rows, cols, dist[rows, cols]


def _tile_candidates(q: np.ndarray, q2: np.ndarray, narrow: np.ndarray, own: np.ndarray, v: np.ndarray, k: int, limit: np.ndarray):
    """Pairs (row, column, distance) of the rows ``own`` that can still be among the ``k`` nearest of their query.

    ``narrow`` is ``q`` in single precision, ``q2`` are its squares. All pairs are measured
    in it first; its error is at most ``slack``, and what is within reach is measured again
    in double precision. Where that spares little, all pairs are.
    """
    q2, limit, v2 = q2[own], limit[own], _squares(v)
    largest = np.fmax.reduce(v2, initial=0.0)
    if len(own) and np.fmax.reduce(q2, initial=0.0) + largest < 1e30:
        # Less the square of the query, which is the same for all of its pairs.
        dist = narrow[own] @ (-2.0 * v).astype(np.float32).T
        dist += v2.astype(np.float32)
        # Twice (dim + 8) roundings of 2^-24; and what rounding to digits may bring together.
        slack = 2.0 * (q.shape[1] + 8) * 2.0**-24 * (q2 + largest)
        bound = limit - q2 + slack + 10.0**-DIGITS
        fresh = np.flatnonzero(np.isinf(limit))
        if len(fresh) and dist.shape[1] > k:
            k_th = np.partition(dist[fresh], k - 1, axis=1)[:, k - 1]
            bound[fresh] = k_th + 2 * slack[fresh] + 2 * 10.0**-DIGITS
        rows, cols = np.divmod(np.flatnonzero(dist <= bound.astype(np.float32)[:, None]), dist.shape[1])
        if len(rows) <= k * len(own) + dist.size // 8:
            dist = _exact(q, v, own[rows], cols)
            near = dist <= limit[rows]
            return own[rows[near]], cols[near], dist[near]
    rows, cols, dist = _all_candidates(q[own], v, k, limit)
    return own[rows], cols, dist


def _matrix(column: pa.Array, dim: int, cosine: bool) -> np.ndarray:
    matrix = arrow_matrix(column, dim)
    return unit_rows(matrix) if cosine else matrix


def _hits(query: pa.Array, item: pa.Array, dist: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([query, item, pa.array(dist)], names=["query_id", "item_id", "distance"])


def widened(bound: np.ndarray) -> np.ndarray:
    """A distance bound that also lets through what ties with it after rounding."""
    return np.sqrt(bound**2 + 2 * 10.0**-DIGITS) + 1e-4


class Best:
    """The ``k`` nearest items met so far of each of ``n`` queries; with a ``limit`` those not beyond it."""

    def __init__(self, n: int, k: int, limit: np.ndarray | None = None):
        self.k, self.limit, self.squares = k, np.full(n, np.inf) if limit is None else limit.copy(), None
        self.best, self.pending, self.waiting = None, [], 0

    def look(self, q: np.ndarray, narrow: np.ndarray, asked: np.ndarray | None, ids: np.ndarray, v: np.ndarray) -> None:
        """Items with their vectors, for the queries ``asked`` (None: all); ``narrow`` is ``q`` in single precision."""
        if self.squares is None:
            self.squares = _squares(q)
        asked = np.arange(len(q)) if asked is None else asked
        step = max(1, MAX_TILE // max(1, len(v)))
        for at in range(0, len(asked), step):
            rows, cols, dist = _tile_candidates(q, self.squares, narrow, asked[at : at + step], v, self.k, self.limit)
            self.add(rows, ids[cols], dist)

    def add(self, rows: np.ndarray, items: np.ndarray, dist: np.ndarray) -> None:
        """Candidates: query rows, items and distances."""
        self.pending.append((rows, items, dist))
        self.waiting += len(rows)
        if self.waiting > max(MERGE_ROWS, len(self.best[0]) if self.best else 0):
            self.merge()

    def merge(self) -> None:
        """Bring the candidates into the best, which may lower the limits."""
        parts = [*([self.best] if self.best else []), *self.pending]
        self.best = _best(*(np.concatenate(p) for p in zip(*parts, strict=True)), self.k)
        self.pending, self.waiting = [], 0
        full, counts = np.unique(self.best[0], return_counts=True)
        ends = np.cumsum(counts) - 1
        self.limit[full[counts == self.k]] = self.best[2][ends[counts == self.k]]

    def rows(self):
        """Query rows, items and distances."""
        if self.pending:
            self.merge()
        return self.best or (EMPTY, EMPTY[:, None], np.zeros(0))


def _scan_kernel(shared: Broadcast, k: int, dim: int, cosine: bool):
    """Best ``k`` of each query over a task's items.

    ``shared`` holds the query ids, their matrix, a route: None, or what gets for each
    cell the queries that look into it, and None or a distance for each query beyond which
    nothing is looked for. Routed items carry their cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, route, limit = shared.value
        narrow = q.astype(np.float32)
        best, kind = Best(len(q), k, limit), None
        for batch in batches:
            kind = batch.column("item_id").type
            cells = batch.column("cell").to_numpy() if route is not None else np.zeros(batch.num_rows, int)
            cuts = np.r_[0, np.flatnonzero(np.diff(cells)) + 1, batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                asked = None if route is None else route.get(int(cells[lo]), EMPTY)
                for at in range(lo, hi if asked is None or len(asked) else lo, BLOCK_ROWS):
                    part = batch.slice(at, min(BLOCK_ROWS, hi - at))
                    v = _matrix(part.column("vec"), dim, cosine)
                    best.look(q, narrow, asked, id_numbers(part.column("item_id")), v)
        rows = best.rows()
        if len(rows[0]):
            yield _hits(ids.take(pa.array(rows[0])), id_column(rows[1], kind), rows[2])

    return run


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best hits of each query with their rank."""
    best = first_k(hits, ["query_id"], [F.col("distance"), F.col("item_id")], k, "rank")
    return best.select("query_id", "item_id", F.col("rank").cast("bigint"), "distance")


def limits(found: DataFrame, ids: pa.Array, k: int) -> np.ndarray:
    """For each of ``ids`` the distance of its ``k``-th hit, inf where it has fewer; their number is bounded."""
    table = found.where(F.col("rank") == k).select("query_id", "distance").toArrow().combine_chunks()
    column = table.column("query_id")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    known = map(tuple, id_numbers(column).tolist()) if table.num_rows else ()
    k_th = dict(zip(known, table.column("distance").to_pylist(), strict=True))
    return np.array([k_th.get(i, np.inf) for i in map(tuple, id_numbers(ids).tolist())], float)


def bounded_rows(limited: DataFrame, dim: int, cosine: bool) -> tuple[pa.Array, np.ndarray]:
    """Ids and matrix of a table of (id, vec) whose number of rows is bounded."""
    table = limited.toArrow().combine_chunks()
    ids, vectors = (
        column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column for column in table.columns
    )
    return ids, _matrix(vectors, dim, cosine)


def scan(
    collection: DataFrame,
    ids: pa.Array,
    queries: np.ndarray,
    dim: int,
    k: int,
    cosine: bool,
    schema: str,
    route=None,
    limit: np.ndarray | None = None,
) -> DataFrame:
    """Best ``k`` per query and task, for a query matrix of bounded size (see ``_scan_kernel``)."""
    shared = collection.sparkSession.sparkContext.broadcast((ids, queries, route, limit))
    columns = ["item_id", "vec", *(["cell"] if route is not None else [])]
    source = collection.select(*columns)
    # Routed items stay in their files, where a cell's rows lie together.
    return (spread(source) if route is None else source).mapInArrow(_scan_kernel(shared, k, dim, cosine), schema)


def tiles(queries: DataFrame, dim: int, cosine: bool, max_numbers: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """All queries (query_id, vec) as bounded matrices with their ids.

    Beyond one matrix the queries are written once and read back in hashed parts.
    """
    cap = max(1, max_numbers // dim)
    ids, rows = bounded_rows(queries.select("query_id", "vec").limit(cap + 1), dim, cosine)
    if len(ids) <= cap:
        yield ids, rows
        return
    stored = written(queries.select("query_id", "vec"), "queries")
    # As full as the hash lets parts be; an unlucky one is cut.
    parts = math.ceil(stored.count() / max(cap / 2, cap - 4 * math.sqrt(cap)))
    for part in range(parts):
        own = stored.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        ids, rows = bounded_rows(own, dim, cosine)
        for at in range(0, len(ids), cap):
            yield ids.slice(at, cap), rows[at : at + cap]


def _blocks(table: DataFrame, dim: int, cosine: bool, numbers: int) -> DataFrame:
    """A table of (id, vec) as rows (block, ids, vectors): matrices of at most ``numbers`` numbers."""
    (name, kind), cap = table.select(table.columns[0]).dtypes[0], max(1, numbers // dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, cap):
                part = batch.slice(at, cap)
                ids = part.column(name)
                rows = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays([ids]))
                vectors = pa.array([_matrix(part.column("vec"), dim, cosine).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([rows, vectors], names=["ids", "vectors"])

    return table.mapInArrow(run, f"ids array<{kind}>, vectors binary").withColumn("block", F.monotonically_increasing_id())


def _pairs_kernel(k: int, dim: int):
    """Best ``k`` of each query over a task's pairs of a query block and an item block, the former's in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, ids, kind = None, None, None, None

        def hits():
            rows = best.rows()
            return _hits(ids.take(pa.array(rows[0])), id_column(rows[1], kind), rows[2])

        def matrix(column: pa.Array, i: int) -> np.ndarray:
            return np.frombuffer(column[i].as_buffer(), np.float64).reshape(-1, dim)

        for batch in batches:
            numbers = batch.column("block").to_pylist()
            for i, number in enumerate(numbers):
                if number != block:
                    if best is not None:
                        yield hits()
                    block, ids = number, pa.concat_arrays([batch.column("query_ids")[i].values])
                    q = matrix(batch.column("queries"), i).copy()
                    narrow, best = q.astype(np.float32), Best(len(q), k)
                items = batch.column("ids")[i].values
                kind = items.type
                best.look(q, narrow, None, id_numbers(items), matrix(batch.column("vectors"), i))
        if best is not None:
            yield hits()

    return run


def scan_pairs(queries: DataFrame, collection: DataFrame, dim: int, k: int, cosine: bool, schema: str, numbers: int) -> DataFrame:
    """Best ``k`` per query and part of the collection, by one job: blocks of queries meet blocks of items.

    A task holds one block of queries at a time and reads its part of the items for each;
    nothing passes through the driver.
    """
    asked = written(_blocks(spread(queries.select("query_id", "vec")), dim, cosine, numbers), "query-blocks")
    items = written(_blocks(spread(collection.select("item_id", "vec")), dim, cosine, SMALL_MATRIX // 4), "item-blocks")
    left = spread(asked).select("block", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    pairs = left.hint("shuffle_replicate_nl").crossJoin(items.select("ids", "vectors"))
    return pairs.mapInArrow(_pairs_kernel(k, dim), schema)


def nearest(
    queries: DataFrame,
    collection: DataFrame,
    dim: int,
    k: int = FETCH_K,
    metric: str = "l2",
    max_numbers: int = MAX_BROADCAST_NUMBERS,
    stored: bool = False,
) -> DataFrame:
    """``queries(query_id, vec)`` against ``collection(item_id, vec)``.

    Returns (query_id, item_id, rank, distance): squared Euclidean distance, for
    ``metric="cosine"`` of the vectors scaled to unit length (2 - 2 cos). With more
    queries than fit one matrix, equal vectors are searched once, the collection is
    written once unless it is ``stored`` already, and each tile of queries scans it; many
    small tiles meet it in one job (``scan_pairs``), sparse vectors by ``sparse_nearest``.
    """
    from casebook.operators import sparse_nearest

    cosine = metric == "cosine"
    schema = hit_schema(queries, collection)
    cap = max(1, max_numbers // dim)
    if queries.limit(cap + 1).count() <= cap:
        ids, rows = next(tiles(queries, dim, cosine, max_numbers))
        return ranked(scan(collection, ids, rows, dim, k, cosine, schema), k)
    items = collection.select("item_id", "vec")
    items = items if stored else written(items, "collection")
    distinct = written(queries.groupBy("vec").agg(F.min("query_id").alias("query_id")), "distinct")
    kinds = dict(queries.dtypes)["vec"], dict(items.dtypes)["vec"]
    if cosine and dim >= 2 * sparse_nearest.FEATURES and all(kind.startswith("struct") for kind in kinds):
        best = sparse_nearest.nearest_sparse(distinct, items, dim, k, schema, max_numbers)
    elif max_numbers < SMALL_MATRIX and distinct.count() > FEW_TILES * cap:
        best = written(ranked(scan_pairs(distinct, items, dim, k, cosine, schema, max_numbers), k), "hits")
    else:
        path = fresh_path(queries.sparkSession, "hits")
        for ids, rows in tiles(distinct, dim, cosine, max_numbers):
            found = ranked(scan(items, ids, rows, dim, k, cosine, schema), k)
            found.write.mode("append").parquet(path)
        best = queries.sparkSession.read.schema(found.schema).parquet(path)
    same = queries.select(F.col("query_id").alias("asked_id"), "vec").join(distinct, "vec").select("asked_id", "query_id")
    return best.join(same, "query_id").select(F.col("asked_id").alias("query_id"), "item_id", "rank", "distance")
