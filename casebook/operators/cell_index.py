"""A stored collection divided into cells, so that a query reads only some of it.

``build`` picks about the square root of the number of vectors as pivots, gives each
vector to its nearest one, and writes the vectors as Parquet partitioned by cell, next
to a small table that describes the cells. A cell of average size then grows like the
square root of the collection too.

``probe`` is approximate: each query looks into its ``probes`` nearest cells, and only
there; distances are exact. How many cells that takes depends on the data and grows
with their number, so unless it is given ``enough_probes`` measures it. ``search`` is exact: it starts from the same cells, which
bounds the distance of the k-th neighbour, and then looks into those other cells that
can hold something nearer to this query. Cells that no query looks into are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.fixed_values import FETCH_K
from casebook.functions.vectors import DIGITS, squared_distances
from casebook.operators.nearest import (
    BLOCK_ROWS,
    MAX_BROADCAST_NUMBERS,
    _matrix,
    bounded_rows,
    hit_schema,
    limits,
    ranked,
    scan,
    tiles,
    widened,
)
from casebook.operators.ordering import spread
from casebook.session import fresh_path, written

#: Share of the exact hits that `enough_probes` reaches, and the most queries it measures it on.
RECALL, MEASURED_QUERIES = 0.9, 256
#: Cells that a query looks into first, for a bound on its hits in the others.
FIRST_CELLS = 2
#: Pivots at most; their matrix goes to every task, and each is a folder. Beyond
#: 16 million vectors cells grow in proportion to the collection.
MAX_PIVOTS = 4096
#: Distances of queries to pivots that the driver holds at once.
MAX_ROUTED = 1_000_000


def _items(folder: str) -> str:
    return f"{folder}/items"


def _cells(folder: str) -> str:
    return f"{folder}/cells"


def _text_of(item: Column, kind: str) -> Column:
    if not kind.startswith("struct"):
        return item.cast("string")
    names = [f.split(":")[0] for f in kind.removeprefix("struct<").removesuffix(">").split(",")]
    return F.concat_ws("-", *(item[n].cast("string") for n in names))


def choose_pivots(collection: DataFrame, dim: int, cosine: bool, pivots: int) -> np.ndarray:
    """The vectors of the ids with the smallest md5, in its order.

    The ids are chosen without reading vectors; then only those rows are fetched.
    """
    digest = F.md5(_text_of(F.col("item_id"), dict(collection.dtypes)["item_id"]).cast("binary"))
    chosen = collection.select("item_id", digest.alias("digest")).orderBy("digest", "item_id").limit(pivots)
    chosen = F.broadcast(written(chosen, "pivots"))
    table = collection.select("item_id", "vec").join(chosen, "item_id").select("digest", "vec")
    ids, matrix = bounded_rows(table, dim, cosine)
    return matrix[np.argsort(np.array(ids.to_pylist(), str), kind="stable")][:pivots]


def _assigned(shared, dim: int, cosine: bool):
    """Nearest pivot of each vector, the first of equally near ones, and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                dist = squared_distances(_matrix(part.column("vec"), dim, cosine), pivots)
                cell = np.round(dist, DIGITS).argmin(axis=1)
                radius = np.sqrt(dist[np.arange(len(cell)), cell])
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id"), part.column("vec"), pa.array(cell.astype(np.int32)), pa.array(radius)],
                    names=["item_id", "vec", "cell", "radius"],
                )

    return run


def pivot_count(n: int) -> int:
    return max(1, min(MAX_PIVOTS, math.ceil(math.sqrt(n))))


def build(collection: DataFrame, folder: str, dim: int, metric: str = "l2", pivots: int | None = None) -> None:
    """Write ``collection(item_id, vec)`` as a cell index."""
    spark = collection.sparkSession
    cosine = metric == "cosine"
    collection = written(collection.select("item_id", "vec"), "collection")
    rows = choose_pivots(collection, dim, cosine, pivots or pivot_count(collection.count()))
    kinds = dict(collection.dtypes)
    assigned = spread(collection).mapInArrow(
        _assigned(spark.sparkContext.broadcast(rows), dim, cosine),
        f"item_id {kinds['item_id']}, vec {kinds['vec']}, cell int, radius double",
    )
    # Rebalancing brings a cell together and splits one that is too large for a task.
    (
        assigned.select("cell", "item_id", "vec", "radius")
        .hint("rebalance", F.col("cell"))
        .sortWithinPartitions("cell")
        .write.partitionBy("cell")
        .parquet(_items(folder))
    )
    schema = f"item_id {kinds['item_id']}, vec {kinds['vec']}, radius double, cell int"
    stats = (
        spark.read.schema(schema)
        .parquet(_items(folder))
        .groupBy("cell")
        .agg(F.count("*").alias("rows"), F.min("radius").alias("low"), F.max("radius").alias("high"))
    )
    known = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(rows)], "cell int, pivot array<double>"
    )
    known.join(stats, "cell").coalesce(1).write.parquet(_cells(folder))


class Routes:
    """For each cell the rows of the queries that look into it, eight queries in a byte."""

    def __init__(self, number: np.ndarray, queries: int):
        self.place, self.queries = {int(c): i for i, c in enumerate(number)}, queries
        self.bits = np.zeros((len(number), -(-queries // 8)), np.uint8)

    def put(self, at: int, near: np.ndarray) -> None:
        """``near`` is queries x cells, for the queries from ``at`` on, which is a multiple of eight."""
        packed = np.packbits(near.T, axis=1)
        self.bits[:, at // 8 : at // 8 + packed.shape[1]] = packed

    def cells(self) -> list[int]:
        filled = self.bits.any(axis=1)
        return [c for c, i in self.place.items() if filled[i]]

    def get(self, cell: int, otherwise: np.ndarray) -> np.ndarray:
        at = self.place.get(cell)
        return otherwise if at is None else np.flatnonzero(np.unpackbits(self.bits[at], count=self.queries))


def _routes(q: np.ndarray, pivot: np.ndarray, number: np.ndarray, near: Callable[[slice, np.ndarray], np.ndarray]) -> Routes:
    """``near(part, distances)`` tells the cells of a part of the queries by their distances to the pivots."""
    routes = Routes(number, len(q))
    step = max(1, MAX_ROUTED // len(number) // 8) * 8
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        routes.put(at, near(part, np.sqrt(squared_distances(q[part], pivot))))
    return routes


def _nearest_cells(d: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest cells of each query, of equally near ones those with smaller numbers, which come first."""
    if n >= d.shape[1]:
        return np.ones(d.shape, bool)
    rounded = np.round(d * d, DIGITS)
    rounded[np.isnan(rounded)] = np.inf
    nth = np.partition(rounded, n - 1, axis=1)[:, n - 1 : n]
    near, ties = rounded < nth, rounded == nth
    return near | (ties & (np.cumsum(ties, axis=1) <= n - near.sum(axis=1, keepdims=True)))


def _by_nearness(q: np.ndarray, pivot: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each query's distances to the pivots, and the places of the cells from its nearest one on."""
    d = np.sqrt(squared_distances(q, pivot))
    return d, np.lexsort((np.broadcast_to(number, d.shape), np.round(d * d, DIGITS)), axis=1)


def _known_cells(spark, folder: str, dim: int) -> tuple[list, np.ndarray, np.ndarray]:
    """The filled cells with their numbers and pivots; at most MAX_PIVOTS rows."""
    cells = spark.read.parquet(_cells(folder)).orderBy("cell").collect()
    return cells, np.array([c["cell"] for c in cells], int), np.array([c["pivot"] for c in cells]).reshape(len(cells), dim)


def enough_probes(queries: DataFrame, folder: str, dim: int, k: int = FETCH_K, metric: str = "l2", recall: float = RECALL) -> int:
    """The fewest nearest cells in which queries find the share ``recall`` of their exact hits.

    Measured on the ``MEASURED_QUERIES`` queries with the smallest md5 of 'query ' and their id, against
    ``search``. Their mean share less two standard errors has to reach ``recall``, so
    that it holds for the other queries too; all cells are enough for any share.
    """
    spark = queries.sparkSession
    cells, number, pivot = _known_cells(spark, folder, dim)
    # Not by the md5 of the id alone: that picks the pivots, which are nearer to their own cells than other queries.
    text = F.concat(F.lit("query "), _text_of(F.col("query_id"), dict(queries.dtypes)["query_id"]))
    digest = F.md5(text.cast("binary"))
    asked = written(queries.select("query_id", "vec").orderBy(digest, "query_id").limit(MEASURED_QUERIES), "asked")
    items = spark.read.parquet(_items(folder)).select("item_id", "cell")
    # At most MEASURED_QUERIES x k rows.
    hits = search(asked, folder, dim, k, metric).join(items, "item_id").select("query_id", "cell").collect() if cells else []
    if not hits:
        return max(1, len(cells))
    ids, q = bounded_rows(asked, dim, metric == "cosine")
    place = np.argsort(_by_nearness(q, pivot, number)[1], axis=1)
    row = {str(i): n for n, i in enumerate(spark_values(ids))}
    column = {c: n for n, c in enumerate(number.tolist())}
    query = np.array([row[str(h["query_id"])] for h in hits])
    cell = np.array([column[h["cell"]] for h in hits])
    found = np.zeros(place.shape)
    np.add.at(found, (query, place[query, cell]), 1.0)
    found = found[found.any(axis=1)]
    share = found.cumsum(axis=1) / found.sum(axis=1, keepdims=True)
    low = np.round(share.mean(axis=0) - 2 * share.std(axis=0) / math.sqrt(len(share)), 9)
    return int(np.argmax(low >= recall)) + 1


def _looked_up(
    queries: DataFrame, folder: str, dim: int, k: int, metric: str, probes: int, max_numbers: int, exact: bool
) -> DataFrame:
    spark = queries.sparkSession
    cosine = metric == "cosine"
    items = spark.read.parquet(_items(folder)).select("cell", "item_id", "vec")
    schema = hit_schema(queries, items)
    cells, number, pivot = _known_cells(spark, folder, dim)
    low, high = (np.array([c[name] for c in cells]) for name in ("low", "high"))

    def read(ids: pa.Array, q: np.ndarray, routes: Routes, limit: np.ndarray | None = None) -> DataFrame:
        part = items.filter(F.col("cell").isin(routes.cells()))
        return ranked(scan(part, ids, q, dim, k, cosine, schema, routes, limit), k)

    def one(ids: pa.Array, q: np.ndarray) -> DataFrame:
        firsts = probes if exact else min(probes, FIRST_CELLS)
        found = read(ids, q, _routes(q, pivot, number, lambda part, d: _nearest_cells(d, firsts)))
        if not exact and probes <= FIRST_CELLS:
            return found
        # What the first cells hold bounds what has to be measured exactly in the others.
        found = written(found, "probe")
        limit = limits(found, ids, k)
        reach = widened(np.sqrt(limit))[:, None]

        def others(part: slice, d: np.ndarray) -> np.ndarray:
            wanted = np.maximum(d - high[None, :], low[None, :] - d) <= reach[part] if exact else _nearest_cells(d, probes)
            return wanted & ~_nearest_cells(d, firsts)

        rest = _routes(q, pivot, number, others)
        if not rest.bits.any():
            return found
        return ranked(found.drop("rank").unionByName(read(ids, q, rest, limit).drop("rank")), k)

    if not len(cells):
        return ranked(spark.createDataFrame([], schema), k)
    path = fresh_path(spark, "hits")
    for ids, q in tiles(queries, dim, cosine, max_numbers):
        hits = one(ids, q)
        hits.write.mode("append").parquet(path)
    return spark.read.schema(hits.schema).parquet(path)


def spark_values(ids: pa.Array) -> list:
    """Ids as Spark's rows give them to Python."""
    from pyspark.sql import Row

    return [Row(**x) if isinstance(x, dict) else x for x in ids.to_pylist()]


def search(
    queries: DataFrame,
    folder: str,
    dim: int,
    k: int = FETCH_K,
    metric: str = "l2",
    probes: int = 2,
    max_numbers: int = MAX_BROADCAST_NUMBERS,
) -> DataFrame:
    """Same rows as ``nearest`` over the indexed collection."""
    return _looked_up(queries, folder, dim, k, metric, probes, max_numbers, True)


def probe(
    queries: DataFrame,
    folder: str,
    dim: int,
    k: int = FETCH_K,
    metric: str = "l2",
    probes: int | None = None,
    max_numbers: int = MAX_BROADCAST_NUMBERS,
) -> DataFrame:
    """The ``k`` nearest among the items of each query's ``probes`` nearest cells, see ``enough_probes``."""
    probes = probes or enough_probes(queries, folder, dim, k, metric)
    return _looked_up(queries, folder, dim, k, metric, probes, max_numbers, False)
