"""Exact nearest neighbours of many sparse queries in a large table of sparse vectors, by cosine.

A question has some ten buckets and a chunk some hundred, so a dense product of all
buckets is mostly zeros. Here the buckets are gathered into ``FEATURES`` groups of about
the same weight, frequent buckets in groups of their own. In a group a product is at most
the sum of the query's weights times the largest weight of the item, so the product of two
short rows bounds that of two vectors. Only pairs whose bound reaches what the query's
k-th best requires are measured, in double precision and on the query's own buckets.

Queries come in tiles of bounded size. A tile meets a share of the items first
(1 / ``FIRST_SHARE``), and what it finds there bounds what has to be measured in all others.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.functions.vectors import DIGITS
from casebook.operators.nearest import MAX_BROADCAST_NUMBERS, Best, _hits, _tile_candidates, id_column, id_numbers, limits, ranked
from casebook.session import fresh_path, written

#: Groups of buckets; vectors of fewer than twice as many buckets are better measured densely.
FEATURES = 256
#: Queries in a tile, items and queries that meet at once.
TILE_QUERIES, ITEM_ROWS, QUERY_ROWS = 16_384, 512, 512
#: One item in so many is looked at first.
FIRST_SHARE = 32
#: Queries without a bound that meet items at once.
FRESH_ROWS = 1024
#: Entries of pairs gathered at once, and hits in a batch.
MAX_GATHERED, HIT_ROWS = 1_000_000, 200_000
#: Tasks of a scan for each core.
TASKS_PER_CORE = 2


class Sparse(NamedTuple):
    """Unit rows: where each begins and ends, its buckets and their weights; and its square, 0 for an empty row."""

    offsets: np.ndarray
    idx: np.ndarray
    val: np.ndarray
    squares: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Sparse:
        idx, val = column.field("idx"), column.field("val")
        lengths = np.diff(idx.offsets.to_numpy())
        offsets = np.r_[0, np.cumsum(lengths)].astype(np.int64)
        weights = val.flatten().to_numpy().astype(np.float64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        norm = np.sqrt(np.bincount(row, weights * weights, len(lengths)))
        weights = weights / np.where(norm == 0, 1.0, norm)[row]
        return cls(offsets, idx.flatten().to_numpy(), weights, np.bincount(row, weights * weights, len(lengths)))

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.squares)), np.diff(self.offsets))

    def dense(self, lo: int, hi: int, dim: int) -> np.ndarray:
        at = slice(self.offsets[lo], self.offsets[hi])
        out = np.zeros((hi - lo, dim))
        out[np.repeat(np.arange(hi - lo), np.diff(self.offsets[lo : hi + 1])), self.idx[at]] = self.val[at]
        return out


def balanced_groups(weights: np.ndarray, groups: int) -> np.ndarray:
    """The group of each bucket: from the heaviest on, into the group that has least."""
    heap, group = [(0.0, g) for g in range(groups)], np.zeros(len(weights), np.int64)
    for bucket in np.argsort(-weights, kind="stable"):
        load, g = heapq.heappop(heap)
        group[bucket] = g
        heapq.heappush(heap, (load + float(weights[bucket]) + 1e-12, g))
    return group


class Tile:
    """A tile of queries that items are shown to, block by block."""

    def __init__(self, queries: Sparse, dim: int, k: int, limit: np.ndarray | None):
        self.queries, self.dim, self.k = queries, dim, k
        self.best, self.seen, self.merged = Best(len(queries.squares), k, limit), 0, ITEM_ROWS
        self.group: np.ndarray | None = None
        self.features: np.ndarray | None = None
        # The queries' buckets (as places among the items' weights) and weights, filled up with zeros.
        self.padded: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _prepare(self, items: Sparse) -> None:
        q, n = self.queries, len(self.queries.squares)
        common = np.bincount(q.idx, np.abs(q.val), self.dim) * np.bincount(items.idx, np.abs(items.val), self.dim)
        self.group = balanced_groups(np.sqrt(common), FEATURES)
        sums = np.bincount(q.rows() * FEATURES + self.group[q.idx], np.abs(q.val), n * FEATURES)
        self.features = sums.astype(np.float32).reshape(n, FEATURES)
        for lo in range(0, n, QUERY_ROWS):
            lengths = np.diff(q.offsets[lo : min(lo + QUERY_ROWS, n) + 1])
            filled = np.arange(max(1, int(lengths.max(initial=0)))) < lengths[:, None]
            idx, val = np.zeros(filled.shape, np.int64), np.zeros(filled.shape)
            part = slice(q.offsets[lo], q.offsets[lo + len(lengths)])
            idx[filled], val[filled] = q.idx[part].astype(np.int64) * ITEM_ROWS, q.val[part]
            self.padded.append((idx, val, np.abs(val).astype(np.float32)))

    def look(self, ids: np.ndarray, items: Sparse) -> None:
        """Items with their ids, at most ``ITEM_ROWS``; each time their number has doubled the limits are brought up to date."""
        self._look(ids, items)
        self.seen += len(ids)
        if self.seen >= 2 * self.merged:
            self.merged = self.seen
            if self.best.pending:
                self.best.merge()

    def _look(self, ids: np.ndarray, items: Sparse) -> None:
        if self.group is None:
            self._prepare(items)
        q, best = self.queries, self.best
        fresh = np.isinf(best.limit)
        # Less what rounding to digits and some hundred roundings of 2^-24 may hide.
        needed = (q.squares + items.squares.min(initial=1.0) - best.limit - 10.0**-DIGITS) / 2
        needed = (needed - np.abs(needed) * 4 * (FEATURES + 8) * 2.0**-24 - 1e-12).astype(np.float32)
        if fresh.any():
            self._look_freshly(fresh, ids, items.dense(0, len(ids), self.dim))
        # By bucket, as the items of one query lie close together then, and once more in steps
        # of 1 / 255 of the largest, rounded up, which fit a core's cache.
        weights = np.zeros((self.dim, ITEM_ROWS))
        weights[items.idx, items.rows()] = items.val
        step = max(float(np.abs(items.val).max(initial=0.0)), 1e-30) / 255 * (1 + 1e-9)
        coarse, weights = np.ceil(np.abs(weights) / step).astype(np.uint8).ravel(), weights.ravel()
        largest = np.zeros(len(ids) * FEATURES)
        np.maximum.at(largest, items.rows() * FEATURES + self.group[items.idx], np.abs(items.val))
        features = np.ascontiguousarray(largest.reshape(len(ids), FEATURES).astype(np.float32).T)
        for at, (idx, val, size) in zip(range(0, len(fresh), QUERY_ROWS), self.padded, strict=True):
            own = np.flatnonzero(~fresh[at : at + QUERY_ROWS])
            bounds = self.features[at : at + QUERY_ROWS]
            bounds = (bounds if len(own) == len(bounds) else bounds[own]) @ features
            pairs = np.flatnonzero(bounds >= needed[at + own][:, None])
            many = max(1, MAX_GATHERED // idx.shape[1])
            for lo in range(0, len(pairs), many):
                row, col = np.divmod(pairs[lo : lo + many], len(ids))
                row = own[row]
                places = idx[row] + col[:, None]
                rough = np.einsum("ij,ij->i", coarse[places], size[row], dtype=np.float32) * step
                hopeful = rough >= needed[at + row]
                row, col, places = row[hopeful], col[hopeful], places[hopeful]
                products = np.einsum("ij,ij->i", weights[places], val[row])
                row += at
                dist = np.round(np.maximum(q.squares[row] + items.squares[col] - 2.0 * products, 0.0), DIGITS)
                near = dist <= best.limit[row]
                best.add(row[near], ids[col[near]], dist[near])

    def _look_freshly(self, fresh: np.ndarray, ids: np.ndarray, dense: np.ndarray) -> None:
        """For queries that have no bound yet, all pairs."""
        for at in range(0, len(fresh), FRESH_ROWS):
            own = np.flatnonzero(fresh[at : at + FRESH_ROWS])
            if len(own):
                q = self.queries.dense(at, min(at + FRESH_ROWS, len(fresh)), self.dim)
                squares, limit = self.queries.squares[at : at + FRESH_ROWS], self.best.limit[at : at + FRESH_ROWS].copy()
                rows, cols, dist = _tile_candidates(q, squares, q.astype(np.float32), own, dense, self.k, limit)
                self.best.add(rows + at, ids[cols], dist)
        if self.best.pending:
            self.best.merge()


def _kernel(shared: Broadcast, k: int, dim: int):
    """Best ``k`` of each query of a tile over a task's items; ``shared`` holds their ids, vectors and None or limits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, limit = shared.value
        tile, kind = Tile(queries, dim, k, limit), None
        for batch in batches:
            kind = batch.column("item_id").type
            for at in range(0, batch.num_rows, ITEM_ROWS):
                part = batch.slice(at, ITEM_ROWS)
                tile.look(id_numbers(part.column("item_id")), Sparse.of(part.column("vec")))
        rows = tile.best.rows()
        for at in range(0, len(rows[0]), HIT_ROWS):
            row, item, dist = (x[at : at + HIT_ROWS] for x in rows)
            yield _hits(ids.take(pa.array(row)), id_column(item, kind), dist)

    return run


def _scan(items: DataFrame, ids: pa.Array, queries: Sparse, limit: np.ndarray | None, dim: int, k: int, schema: str) -> DataFrame:
    context = items.sparkSession.sparkContext
    shared = context.broadcast((ids, queries, limit))
    # A task returns up to k rows for each query: a few large tasks for each core.
    return items.coalesce(TASKS_PER_CORE * context.defaultParallelism).mapInArrow(_kernel(shared, k, dim), schema)


def _collected(part: DataFrame) -> tuple[pa.Array, Sparse]:
    """Ids and vectors of a bounded number of queries, the shortest first."""
    table = part.select("query_id", "vec", F.size("vec.idx").alias("n")).toArrow()
    table = table.sort_by("n").combine_chunks()
    ids, vectors = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns[:2])
    return ids, Sparse.of(vectors)


def nearest_sparse(queries: DataFrame, items: DataFrame, dim: int, k: int, schema: str, max_numbers: int = MAX_BROADCAST_NUMBERS) -> DataFrame:
    """``queries(query_id, vec)`` of unlike vectors against ``items(item_id, vec)``, both stored: rows as from ``nearest``."""
    spark = queries.sparkSession
    # Queries and their groups are sent to every task, an entry as a number and a half.
    cap = max(1, min(TILE_QUERIES, 2 * max_numbers // FEATURES))
    n, entries = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("vec.idx")), F.lit(0))).first()
    parts = max(1, math.ceil(n / max(cap / 2, cap - 4 * math.sqrt(cap))), math.ceil(entries * 1.5 / max_numbers))
    first = F.pmod(F.xxhash64("item_id"), F.lit(FIRST_SHARE)) == 0
    path, kinds = fresh_path(spark, "hits"), f"{schema}, rank bigint"
    spark.createDataFrame([], kinds).select("query_id", "item_id", "rank", "distance").write.parquet(path)
    for part in range(parts):
        ids, rows = _collected(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part))
        if not len(ids):
            continue
        found = written(ranked(_scan(items.where(first), ids, rows, None, dim, k, schema), k), "first-hits")
        rest = _scan(items.where(~first), ids, rows, limits(found, ids, k), dim, k, schema)
        ranked(found.drop("rank").unionByName(rest), k).write.mode("append").parquet(path)
    return spark.read.schema(ranked(spark.createDataFrame([], schema), k).schema).parquet(path)
