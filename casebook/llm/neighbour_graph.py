"""Approximate nearest neighbours: NN-descent builds a neighbour graph, a greedy search walks it.

*Building.* Equal vectors are one node. Random hyperplanes cut the nodes into small
leaves, a few times over, and neighbours within leaves are the first graph. Each
round of NN-descent then brings a node's neighbours, and a sample of the nodes it is
a neighbour of, together by joins, compares them pairwise (neighbours of neighbours)
and keeps each node's `NEIGHBOURS` nearest so far; only pairs with a neighbour that
is new to the node are compared. It ends when few neighbours change.

*Searching.* A query keeps a beam of its nearest nodes so far. Each round joins the
beam's nodes that were not yet expanded with the graph, measures their neighbours,
and merges them into the beam, until none is left to expand. A query that is itself
a row starts at its own node, others at a few fixed ones. All queries walk in the
same rounds, their vectors joined to the pairs by query. At the end distances are
measured again on the original vectors in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.session import written

NEIGHBOURS = 32
#: Backward links kept for the search, nearest first; they only add to a node's forward links.
BACKWARD = 16
#: Neighbours of a node that meet in a round, of each kind: new, new backward, old.
SAMPLE = 12
#: New neighbours that one meeting proposes to a node at most; later meetings propose more.
PROPOSALS = 8
ROUNDS, SETTLED = 10, 0.02
TREES, LEAF = 4, 128
BEAM, ENTRIES = 320, 48
SEED = 5

#: Squares below this share of the rows' own lose digits in the product form.
NOISE, PAIRS_AT_ONCE = 1e-6, 4096

EDGE = "node long, other long, d double, fresh boolean"


def _parsed(table: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, vec binary) of the rows that take part, and the numbers' type; one row for each vec_id."""
    element = dict(table.dtypes)["embedding"].removeprefix("array<").removesuffix(">")
    kind = "<f4" if element == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = [], []
            for vec_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                if vec_id is None or not v.is_valid or not len(v) or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False)
                if np.isfinite(x).all() and x.any():
                    ids.append(vec_id)
                    vectors.append((x.astype(kind) + 0.0).astype(kind).tobytes())  # + 0.0: no negative zeros
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], names=["vec_id", "vec"])

    rows = table.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding")
    ).mapInArrow(run, "vec_id long, vec binary")
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec")), kind


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1) if values else np.zeros((0, 1))


def _nearest(node: np.ndarray, other: np.ndarray, d: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each node's nearest distinct others; of a repeated pair the one that is not fresh stays."""
    order = np.lexsort((d, fresh, other, node))
    node, other, d, fresh = node[order], other[order], d[order], fresh[order]
    first = np.ones(len(node), bool)
    first[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])
    node, other, d, fresh = node[first], other[first], d[first], fresh[first]
    order = np.lexsort((other, d, node))
    node, other, d, fresh = node[order], other[order], d[order], fresh[order]
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, int)
    place = np.arange(len(node)) - np.repeat(starts, np.diff(np.append(starts, len(node))))
    keep = place < NEIGHBOURS
    return node[keep], other[keep], d[keep], fresh[keep]


def _merged(edges: DataFrame) -> DataFrame:
    """The graph with each node's nearest neighbours; a node's rows stream by, so a hub needs no room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            arrays = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "other", "d", "fresh")]
            if held is not None:
                arrays = [np.concatenate([h, a]) for h, a in zip(held, arrays, strict=True)]
            arrays = _nearest(*arrays)
            last = arrays[0] == arrays[0][-1]
            held = [a[last] for a in arrays]
            yield pa.RecordBatch.from_arrays([pa.array(a[~last]) for a in arrays], names=["node", "other", "d", "fresh"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in held], names=["node", "other", "d", "fresh"])

    return edges.repartition("node").sortWithinPartitions("node").mapInArrow(run, EDGE)


def _distances(x: np.ndarray) -> np.ndarray:
    """Distances between the rows, from the original numbers in double precision.

    The product form is fast, but where a distance is small against the rows' lengths it
    is rounding noise; such pairs are measured again from their differences.
    """
    x, power = x.astype(np.float64), 0
    for shifted in (False, True):  # an offset that all rows share goes
        x = x - x[0] if shifted else x
        top = np.abs(x).max(initial=0)
        if top > 1e100 or 0 < top < 1e-100:  # squares would leave the range; powers of two scale without loss
            step = int(np.frexp(top)[1]) + 1
            x, power = np.ldexp(x, -step), power + step
    norm = (x * x).sum(axis=1)
    square = norm[:, None] + norm[None] - 2 * (x @ x.T)
    np.fill_diagonal(square, np.inf)
    close = square <= NOISE * (norm[:, None] + norm[None])
    near_a, near_b = np.nonzero(close) if close.any() else ((), ())
    np.fill_diagonal(square, 0)
    for k in range(0, len(near_a), PAIRS_AT_ONCE):
        a, b = near_a[k : k + PAIRS_AT_ONCE], near_b[k : k + PAIRS_AT_ONCE]
        diff = x[a] - x[b]
        square[a, b] = (diff * diff).sum(axis=1)
    d = np.sqrt(np.maximum(square, 0))
    return np.ldexp(d, power) if power else d


def _spread(nodes: DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Middle and width of each component over all nodes, so that the planes cut where the vectors are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vec"), kind).astype(np.float64)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low)), pa.int32()), pa.array(low), pa.array(high)], names=["i", "low", "high"])

    parts = nodes.select("vec").mapInArrow(run, "i int, low double, high double")
    # One row for each component.
    rows = parts.groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    low, high = np.array([r.low for r in rows]), np.array([r.high for r in rows])
    width = np.ldexp(np.ones(len(low)), np.frexp((high / 2 - low / 2).max(initial=0))[1])
    return low / 2 + high / 2, width


def _first_graph(nodes: DataFrame, kind: str, n: int) -> DataFrame:
    """Neighbours within leaves of random hyperplane trees; a large leaf is split by hash."""
    depth = max(0, math.ceil(math.log2(max(n, 1) / LEAF)))
    middle, width = _spread(nodes, kind)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = (_matrix(batch.column("vec"), kind) - middle) / width
            rng = np.random.default_rng(SEED)
            planes = rng.normal(size=(x.shape[1], TREES * depth))
            sides = (x @ planes > 0).reshape(len(x), TREES, depth)
            codes = (sides * (1 << np.arange(depth, dtype=np.int64))).sum(axis=2)
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), pa.array(np.full(len(x), t, np.int32)), pa.array(codes[:, t]), batch.column("vec")],
                    names=["node", "tree", "code", "vec"],
                )

    leaves = written(nodes.select("node", "vec").mapInArrow(placed, "node long, tree int, code long, vec binary"), "leaves")
    sizes = leaves.groupBy("tree", "code").agg(F.ceil(F.count("*") / LEAF).cast("int").alias("parts"))
    split = leaves.join(sizes, ["tree", "code"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))
    # The join leaves a leaf in one place, which would satisfy the grouping too: deal its parts out.
    split = split.repartition("tree", "code", "part")

    def within(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        d = _distances(_matrix(table.column("vec").combine_chunks(), kind))
        np.fill_diagonal(d, np.inf)
        k = min(NEIGHBOURS // 2, len(ids) - 1)
        if k <= 0:
            return pa.table({c: pa.array([], t) for c, t in (("node", pa.int64()), ("other", pa.int64()), ("d", pa.float64()), ("fresh", pa.bool_()))})
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        return pa.table(
            {
                "node": pa.array(np.repeat(ids, k)),
                "other": pa.array(ids[near].ravel()),
                "d": pa.array(np.take_along_axis(d, near, axis=1).ravel()),
                "fresh": pa.array(np.ones(len(ids) * k, bool)),
            }
        )

    return _merged(split.groupBy("tree", "code", "part").applyInArrow(within, EDGE))


def _ranked(df: DataFrame, key: str, *order: Column, most: int) -> DataFrame:
    window = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("place", F.row_number().over(window)).where(F.col("place") <= most).drop("place")


def _meeting(graph: DataFrame, nodes: DataFrame, kind: str, turn: int) -> tuple[DataFrame, DataFrame]:
    """New pairs from the meetings of one round, and the graph with those that met no longer fresh."""
    by_d = [F.col("d"), F.col("other")]
    met = _ranked(graph.where("fresh"), "node", *by_d, most=SAMPLE).select("node", "other")
    met = written(met, "met")
    old = _ranked(graph.where("not fresh"), "node", F.xxhash64("other", "node", F.lit(turn)), F.col("other"), most=SAMPLE)
    back = met.select(F.col("other").alias("node"), F.col("node").alias("other"))
    back = _ranked(back, "node", F.xxhash64("other", "node", F.lit(turn)), F.col("other"), most=SAMPLE)
    members = met.union(back).withColumn("fresh", F.lit(True)).union(old.select("node", "other", F.lit(False).alias("fresh")))
    reach = graph.groupBy(F.col("node").alias("other")).agg(
        F.when(F.count("*") >= NEIGHBOURS, F.max("d")).otherwise(F.lit(float("inf"))).alias("reach")
    )
    points = nodes.select(F.col("node").alias("other"), "vec").join(reach, "other", "left")
    groups = (
        members.join(points, "other")
        .groupBy("node")
        .agg(F.collect_list(F.struct("other", "fresh", F.coalesce("reach", F.lit(float("inf"))).alias("reach"), "vec")).alias("m"))
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            column = batch.column("m")
            for g in range(batch.num_rows):
                group = column[g].values
                ids = group.field("other").to_numpy()
                fresh = group.field("fresh").to_numpy(zero_copy_only=False)
                d = _distances(_matrix(group.field("vec"), kind))
                allowed = (fresh[:, None] | fresh[None]) & (ids[:, None] != ids[None]) & (d < group.field("reach").to_numpy()[:, None])
                d = np.where(allowed, d, np.inf)
                k = min(PROPOSALS, len(ids))
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                value = np.take_along_axis(d, near, axis=1)
                row, place = np.nonzero(np.isfinite(value))
                out[0].append(ids[row])
                out[1].append(ids[near[row, place]])
                out[2].append(value[row, place])
            node, other, d = (np.concatenate(x) if x else np.zeros(0) for x in out)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(node.astype(np.int64)),
                    pa.array(other.astype(np.int64)),
                    pa.array(d.astype(np.float64)),
                    pa.array(np.ones(len(node), bool)),
                ],
                names=["node", "other", "d", "fresh"],
            )

    pairs = groups.mapInArrow(compared, EDGE)
    settled = graph.join(met.withColumn("done", F.lit(True)), ["node", "other"], "left").select(
        "node", "other", "d", (F.col("fresh") & F.col("done").isNull()).alias("fresh")
    )
    return pairs, settled


def neighbour_graph(nodes: DataFrame, kind: str, n: int) -> DataFrame:
    """(node, others): each node's neighbours, the nearest forward ones and then some backward ones.

    `nodes` has (node, vec binary of numbers of type `kind`).
    """

    graph = written(_first_graph(nodes, kind, n), "graph")
    for turn in range(ROUNDS):
        pairs, settled = _meeting(graph, nodes, kind, turn)
        graph = written(_merged(settled.union(pairs)), "graph")
        if graph.where("fresh").count() <= SETTLED * n * NEIGHBOURS:
            break
    backward = graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "d")
    backward = _ranked(backward, "node", F.col("d"), F.col("other"), most=BACKWARD)
    both = graph.select("node", "other").union(backward.select("node", "other"))
    return both.groupBy("node").agg(F.collect_set("other").alias("others"))


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each row of `a` from the same row of `b`, in double precision."""
    with np.errstate(over="ignore"):
        diff = a.astype(np.float64) - b.astype(np.float64)
    top = np.abs(diff).max(axis=1, initial=0)
    step = np.where((top > 1e100) & np.isfinite(top), np.frexp(top)[1], 0)  # squares would leave the range
    diff = np.ldexp(diff, -step[:, None])
    with np.errstate(over="ignore"):
        return np.ldexp(np.sqrt((diff * diff).sum(axis=1)), step)


def _search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, kind: str) -> DataFrame:
    """(query_id, node, d): the beam of each query (query_id, node or null, vec) at the end of its walk."""
    asked = queries.select("query_id", F.col("vec").alias("here"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                d = _lengths(_matrix(part.column("here"), kind), _matrix(part.column("vec"), kind)) if part.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("query_id"), part.column("node"), pa.array(d)], names=["query_id", "node", "d"]
                )

    def with_distance(pairs: DataFrame) -> DataFrame:
        found = pairs.join(asked, "query_id").join(nodes.select("node", "vec"), "node").select("query_id", "node", "here", "vec")
        return found.mapInArrow(measured, "query_id long, node long, d double").withColumn("done", F.lit(False))

    entries = nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(ENTRIES)
    # A fixed number of entries against the queries.
    few = [r.node for r in entries.collect()]
    starts = queries.select("query_id", F.explode(F.array(*map(F.lit, few))).alias("node"))
    own = queries.where("node is not null").select("query_id", "node")
    beam = written(_best(with_distance(starts.union(own).distinct())), "beam")
    while True:  # every round expands nodes that stay expanded, so it ends
        open_ = beam.where("not done").select("query_id", "node")
        if not open_.limit(1).count():
            return beam
        reached = open_.join(graph, "node").select("query_id", F.explode("others").alias("node")).distinct()
        fresh = reached.join(beam.select("query_id", "node"), ["query_id", "node"], "left_anti")
        beam = written(_best(beam.withColumn("done", F.lit(True)).union(with_distance(fresh))), "beam")


def _best(rows: DataFrame) -> DataFrame:
    return _ranked(rows, "query_id", F.col("d"), F.col("node"), most=BEAM)


def nearest(table: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The k nearest found rows of every query row: query_id, rank, vec_id, score (Euclidean distance).

    `table` has (vec_id, embedding); `is_query` picks the queries. A query's own row
    is no candidate, rows with an equal vector are. Ties go to the smaller vec_id.
    Vectors that are null, empty, zero, or hold null or non-finite numbers take no
    part, nor do rows with a null vec_id or with another length than the most
    frequent one. Of rows with the same vec_id one counts. With fewer candidates
    than k all are returned; an empty table gives no rows.
    """
    spark = table.sparkSession
    rows, kind = _parsed(table)
    rows = written(rows, "vectors")
    lengths = rows.groupBy(F.octet_length("vec").alias("size")).agg(F.count("*").alias("n"))
    usual = lengths.orderBy(F.desc("n"), "size").limit(1).first()
    result = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return spark.createDataFrame([], result)
    rows = rows.where(F.octet_length("vec") == usual["size"])
    # The k + 1 smallest ids of equal vectors are all that a result can hold.
    window = Window.partitionBy("vec").orderBy("vec_id")
    held = rows.withColumn("place", F.row_number().over(window)).where(F.col("place") <= k + 1)
    nodes = written(held.groupBy("vec").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    n = nodes.count()
    graph = written(neighbour_graph(nodes, kind, n), "adjacent")
    queries = written(
        rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vec").join(nodes.select("node", "vec"), "vec").select("query_id", "node", "vec"), "queries"
    )
    return _exact(_search(queries, nodes, graph, kind), queries, nodes, kind, k)


def _exact(beam: DataFrame, queries: DataFrame, nodes: DataFrame, kind: str, k: int) -> DataFrame:
    """The k nearest rows of the beam's nodes by distances on the original vectors."""
    near = _ranked(beam, "query_id", F.col("d"), F.col("node"), most=k + 1).select("query_id", "node")
    rows = near.join(nodes.withColumnRenamed("vec", "there"), "node").join(queries.select("query_id", F.col("vec").alias("here")), "query_id")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _lengths(_matrix(batch.column("here"), kind), _matrix(batch.column("there"), kind)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("ids"), pa.array(d)], names=["query_id", "ids", "score"])

    found = rows.select("query_id", "ids", "here", "there").mapInArrow(measured, "query_id long, ids array<long>, score double")
    each = found.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
