"""An inverted index of sparse vectors: exact nearest items without reading all of them.

``build`` deals the items into parts by a hash and writes each part's postings (item,
weight), bucket by bucket by falling weight, cut into blocks that know their largest
weight; a frequent bucket is blocks of every part. The vectors are written next to them
in the same parts, so that single items can be fetched.

``search`` is exact for unit vectors with weights of at least 0. The first block of
each bucket that a query has gives it candidates; the k-th best of their exact scores is
a bound. The bound is then dealt out over the query's buckets as allowances, so that
blocks whose largest product lies within their bucket's allowance are skipped: an item
that appears in skipped postings only stays below the bound. Queries meet the postings
part by part: what is read is summed per item, the k-th largest sum of a part is a second
bound, and where an item's sum and the remaining allowances reach it, the part's other
postings of the query are read too. Only a part's best leave it; those within reach of
the k-th best of all parts are scored exactly.

Items without any bucket of a query are no hits of it. Distances are rounded before
they are ranked, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.fixed_values import FETCH_K
from casebook.functions.vectors import DIGITS, arrow_matrix, unit_rows
from casebook.operators.indexing import vector_entries
from casebook.operators.ordering import first_k
from casebook.session import written

#: Postings in a block at most.
BLOCK_POSTINGS = 512
#: Items in a part, about; parts at most (their numbers pass through the driver).
PART_ROWS, MAX_PARTS = 16_384, 4096
#: Queries that meet a part at once, about.
TILE_QUERIES = 16_384
#: Steps of the weight scale by which a bucket's blocks are counted: so many for each factor of two.
LEVELS = 4
#: What rounding may hide between two scores.
MARGIN = 1e-5
#: Rows scored at once.
SCORED_ROWS = 1024
EMPTY = np.zeros(0, np.int64)


def _blocks(folder: str) -> str:
    return f"{folder}/blocks"


def _vectors(folder: str) -> str:
    return f"{folder}/vectors"


def _kinds(folder: str) -> str:
    return f"{folder}/kinds"


def _schema(folder: str, spark: SparkSession) -> str:
    kind = dict(spark.read.parquet(_kinds(folder)).dtypes)["item_id"]
    return f"no bigint, item_id {kind}, vec struct<idx:array<int>,val:array<double>>, part int"


def _cut(size: int):
    """The vectors of a part to rows of at most ``size`` postings of one bucket, by falling weight."""

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        vec = part.column("vec").combine_chunks()
        idx, val = vec.field("idx"), vec.field("val")
        no = np.repeat(part.column("no").to_numpy(), np.diff(idx.offsets.to_numpy()))
        bucket, weight = idx.flatten().to_numpy(), val.flatten().to_numpy()
        order = np.lexsort((no, -weight, bucket))
        no, bucket, weight = no[order], bucket[order].astype(np.int64), weight[order]
        firsts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
        place = np.arange(len(bucket)) - np.repeat(firsts, np.diff(np.r_[firsts, len(bucket)]))
        starts = np.flatnonzero(place % size == 0)
        offsets = pa.array(np.r_[starts, len(bucket)].astype(np.int32))
        own = pa.array(np.full(len(starts), part.column("part")[0].as_py(), np.int32))
        return pa.table(
            {
                "part": own,
                "bucket": bucket[starts],
                "top": weight[starts],
                "items": pa.ListArray.from_arrays(offsets, pa.array(no)),
                "weights": pa.ListArray.from_arrays(offsets, pa.array(weight)),
            }
        )

    return run


def part_of(item, parts: int):
    return F.pmod(F.xxhash64(item), F.lit(parts)).cast("int")


def build(items: DataFrame, folder: str) -> None:
    """Write ``items(item_id, vec)``, sparse unit vectors, as an inverted index."""
    # Postings hold an item's number, given once as it is written, instead of its id.
    stored = written(items.select(F.monotonically_increasing_id().alias("no"), "item_id", "vec"), "vectors")
    parts = max(1, min(MAX_PARTS, -(-stored.count() // PART_ROWS)))
    placed = stored.withColumn("part", part_of("no", parts))
    placed.hint("rebalance", F.col("part")).write.partitionBy("part").parquet(_vectors(folder))
    cut = placed.select("part", "no", "vec").groupBy("part").applyInArrow(
        _cut(BLOCK_POSTINGS), "part int, bucket bigint, top double, items array<bigint>, weights array<double>"
    )
    # Numbers by place in the written table: unique, and nothing depends on their order.
    numbered = cut.withColumn("block", F.monotonically_increasing_id()).withColumn("n", F.size("items"))
    numbered.write.parquet(_blocks(folder))
    # The kind of the ids, for an index without rows.
    stored.limit(0).select("item_id").write.parquet(_kinds(folder))


def _scored(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, parts: int) -> DataFrame:
    """Exact (query_id, item_id, distance) of pairs (query_id, no)."""
    placed = pairs.withColumn("part", part_of("no", parts))
    # At most MAX_PARTS numbers: only the parts that hold a candidate are read.
    wanted = [r[0] for r in placed.select("part").distinct().collect()]
    rows = (
        placed.join(vectors.where(F.col("part").isin(wanted)), ["part", "no"])
        .join(queries.select("query_id", F.col("vec").alias("query_vec")), "query_id")
        .select("query_id", "item_id", "vec", "query_vec")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SCORED_ROWS):
                part = batch.slice(at, SCORED_ROWS)
                a, b = part.column("query_vec"), part.column("vec")
                dim = 1 + max((int(x.field("idx").flatten().to_numpy().max(initial=0)) for x in (a, b)), default=0)
                left, right = unit_rows(arrow_matrix(a, dim)), unit_rows(arrow_matrix(b, dim))
                distance = np.maximum((left * left).sum(1) + (right * right).sum(1) - 2 * (left * right).sum(1), 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("query_id"), part.column("item_id"), pa.array(np.round(distance, DIGITS))],
                    names=["query_id", "item_id", "distance"],
                )

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, distance double")


def _read(wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """Postings of wanted blocks (query_id, w, allowance, block): (query_id, no, product, allowance)."""
    entry = F.explode(F.arrays_zip("items", "weights")).alias("e")
    return (
        wanted.join(blocks.select("block", "items", "weights"), "block")
        .select("query_id", "w", "allowance", entry)
        .select("query_id", F.col("e.items").alias("no"), (F.col("w") * F.col("e.weights")).alias("product"), "allowance")
        .where(F.col("product") > F.col("allowance"))
    )


def _bounds(asked: DataFrame, queries: DataFrame, blocks: DataFrame, vectors: DataFrame, parts: int, k: int) -> DataFrame:
    """(query_id, bound): the k-th best exact score among the items of the buckets' first blocks."""
    firsts = blocks.groupBy("bucket").agg(F.max_by("block", "top").alias("block"))
    wanted = asked.join(firsts, "bucket").select("query_id", "w", F.lit(0.0).alias("allowance"), "block")
    sums = _read(wanted, blocks).groupBy("query_id", "no").agg(F.sum("product").alias("sum"))
    return _kth_best(sums, queries, vectors, parts, k)


def _kth_best(sums: DataFrame, queries: DataFrame, vectors: DataFrame, parts: int, k: int) -> DataFrame:
    """(query_id, bound): the k-th best exact score among the 2 k items of each query with the largest sums, less the margin."""
    best = written(first_k(sums, ["query_id"], [F.desc("sum"), F.col("no")], 2 * k, "rank").select("query_id", "no"), "first")
    scored = _scored(best, queries, vectors, parts)
    ranked = first_k(scored, ["query_id"], [F.col("distance"), F.col("item_id")], k, "rank")
    return ranked.where(F.col("rank") == k).select("query_id", (1 - F.col("distance") / 2 - MARGIN).alias("bound"))


def allowances(asked: DataFrame, blocks: DataFrame, bounds: DataFrame) -> DataFrame:
    """Each (query_id, bucket, w) with the product up to which its postings may be skipped.

    For a bucket the best offer is the weight that skips most postings for what it
    costs; offers are taken in the order of that ratio until the bound is spent. The
    sum over a query's buckets is at most its bound.
    """
    level = F.ceil(F.log2("top") * LEVELS)
    # At most one row per bucket and level.
    counted = blocks.groupBy("bucket", level.alias("level")).agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    up_to = Window.partitionBy("bucket").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("skips", F.sum("n").over(up_to))
    offers = asked.join(counted, "bucket").join(bounds, "query_id").where("bound > 0")
    cost = F.col("w") * F.col("top")
    best = offers.groupBy("query_id", "bucket", "w", "bound").agg(
        F.max(F.struct((F.col("skips") / cost).alias("ratio"), cost.alias("cost"))).alias("offer")
    )
    spent = Window.partitionBy("query_id").orderBy(F.desc("offer.ratio"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.col("bound") - F.coalesce(F.sum("offer.cost").over(spent), F.lit(0.0)), F.lit(0.0))
    taken = best.withColumn("taken", F.least(left, F.col("offer.cost")))
    # What is left over raises all allowances of the query in proportion.
    share = F.col("taken") * F.col("bound") / F.sum("taken").over(Window.partitionBy("query_id"))
    dealt = taken.select("query_id", "bucket", share.alias("allowance"))
    return asked.join(dealt, ["query_id", "bucket"], "left").select(
        "query_id", "bucket", "w", F.coalesce("allowance", F.lit(0.0)).alias("allowance")
    )


def wanted_blocks(dealt: DataFrame, blocks: DataFrame) -> DataFrame:
    """The blocks that are read: (query_id, bucket, w, allowance, block, n)."""
    return dealt.join(blocks.select("bucket", "block", "top", "n"), "bucket").where(F.col("w") * F.col("top") > F.col("allowance"))


class _Part:
    """The postings of a part: the items' numbers, and for each bucket their places and weights by falling weight."""

    def __init__(self, blocks: pa.Table):
        last = [w[-1].as_py() for w in blocks.column("weights")]
        order = np.lexsort((-np.array(last), -blocks.column("top").to_numpy(), blocks.column("bucket").to_numpy()))
        blocks = blocks.take(pa.array(order)).combine_chunks()
        items, weights = (blocks.column(c).combine_chunks() for c in ("items", "weights"))
        self.no, self.place = np.unique(items.flatten().to_numpy(), return_inverse=True)
        self.weight = weights.flatten().to_numpy()
        bucket = np.repeat(blocks.column("bucket").to_numpy(), np.diff(items.offsets.to_numpy()))
        buckets, starts = np.unique(bucket, return_index=True)
        ends = np.r_[starts[1:], len(bucket)]
        self.ranges = {b: (lo, hi) for b, lo, hi in zip(buckets.tolist(), starts.tolist(), ends.tolist(), strict=True)}

    def best(self, buckets: list, ws: list, allowed: list, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the items that can be among the ``k`` best of a query, ties included."""
        sums, above, rest = np.zeros(len(self.no)), np.zeros(len(self.no)), []
        for bucket, w, allowance in zip(buckets, ws, allowed, strict=True):
            lo, hi = self.ranges.get(bucket, (0, 0))
            to = lo + int(np.searchsorted(-w * self.weight[lo:hi], -allowance))
            at, product = self.place[lo:to], w * self.weight[lo:to]
            sums[at] += product
            above[at] += product - allowance
            rest.append((w, to, hi))
        bound = max(bound, self._kth(sums, k) - MARGIN)
        if not ((above + sum(allowed) >= bound) & (sums > 0)).any():
            return self.no[:0], sums[:0]
        for w, lo, hi in rest:
            sums[self.place[lo:hi]] += w * self.weight[lo:hi]
        found = np.flatnonzero((sums >= max(bound, self._kth(sums, k) - MARGIN)) & (sums > 0))
        return self.no[found], sums[found]

    @staticmethod
    def _kth(sums: np.ndarray, k: int) -> float:
        return float(np.partition(sums, -k)[-k]) if len(sums) >= k else 0.0


def _meet(k: int):
    """Queries (query_id, buckets, ws, allowed, bound) and the blocks of a part: (query_id, no, score) of the part's best."""

    def run(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        ids = asked.column("query_id").combine_chunks()
        rows, nos, scores = [EMPTY], [EMPTY], [np.zeros(0)]
        part = _Part(blocks) if asked.num_rows and blocks.num_rows else None
        if part is not None:
            columns = (asked.column(c).to_pylist() for c in ("buckets", "ws", "allowed", "bound"))
            for row, query in enumerate(zip(*columns, strict=True)):
                no, score = part.best(*query, k)
                rows.append(np.full(len(no), row))
                nos.append(no)
                scores.append(score)
        return pa.table({"query_id": ids.take(pa.array(np.concatenate(rows))), "no": np.concatenate(nos), "score": np.concatenate(scores)})

    return run


def _met(dealt: DataFrame, bounds: DataFrame, blocks: DataFrame, parts: int, k: int) -> DataFrame:
    """(query_id, no, score) of each part's best items of each query, those that tie with its k-th best included."""
    kind = dict(dealt.dtypes)["query_id"]
    entries = F.sort_array(F.collect_list(F.struct("bucket", "w", "allowance")))
    asked = dealt.groupBy("query_id").agg(entries.alias("entries")).join(bounds, "query_id", "left")
    tiles = -(-asked.count() // TILE_QUERIES) or 1
    asked = asked.select(
        "query_id",
        F.col("entries.bucket").alias("buckets"),
        F.col("entries.w").alias("ws"),
        F.col("entries.allowance").alias("allowed"),
        F.greatest(F.coalesce("bound", F.lit(0.0)), F.lit(0.0)).alias("bound"),
        F.pmod(F.xxhash64("query_id"), F.lit(tiles)).cast("int").alias("tile"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
    )
    # A part goes to each tile of the queries; buckets that no query has go nowhere.
    read = blocks.join(dealt.select("bucket").distinct(), "bucket", "left_semi")
    read = read.select("part", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), "bucket", "top", "items", "weights")
    keys = ["part", "tile"]
    return asked.groupBy(*keys).cogroup(read.groupBy(*keys)).applyInArrow(_meet(k), f"query_id {kind}, no bigint, score double")


def search(queries: DataFrame, folder: str, k: int = FETCH_K) -> DataFrame:
    """``queries(query_id, vec)``, sparse unit vectors: (query_id, item_id, rank, distance), the ``k`` nearest.

    Repeated query ids with equal vectors are one query; null or empty vectors find nothing.
    """
    dealt, blocks, vectors, parts, bounds, queries = _dealt(queries, folder, k)
    met = written(_met(dealt, bounds, blocks, parts, k), "met")
    ranked = first_k(met, ["query_id"], [F.desc("score"), F.col("no")], k, "rank")
    least = ranked.where(F.col("rank") == k).select("query_id", (F.col("score") - MARGIN).alias("least"))
    hopeful = (
        met.join(least, "query_id", "left").where(F.col("score") >= F.coalesce("least", F.lit(0.0))).select("query_id", "no")
    )
    scored = _scored(written(hopeful, "hopeful"), queries, vectors, parts)
    best = first_k(scored, ["query_id"], [F.col("distance"), F.col("item_id")], k, "rank")
    return best.select("query_id", "item_id", F.col("rank").cast("bigint"), "distance")


def _dealt(queries: DataFrame, folder: str, k: int):
    spark: SparkSession = queries.sparkSession
    blocks = spark.read.parquet(_blocks(folder))
    vectors = spark.read.schema(_schema(folder, spark)).parquet(_vectors(folder))
    parts = (vectors.agg(F.max("part")).first()[0] or 0) + 1
    queries = written(queries.where("query_id is not null and vec is not null").select("query_id", "vec").distinct(), "asked")
    asked = vector_entries(queries, ["query_id"]).select("query_id", "bucket", F.col("weight").alias("w"))
    bounds = written(_bounds(asked, queries, blocks, vectors, parts, k), "bounds")
    dealt = written(allowances(asked, blocks, bounds), "allowances")
    return dealt, blocks, vectors, parts, bounds, queries


def _wanted(queries: DataFrame, folder: str, k: int):
    """What a search reads at least, as rows of (query, block)."""
    dealt, blocks, vectors, parts, bounds, queries = _dealt(queries, folder, k)
    spare = dealt.groupBy("query_id").agg(F.sum("allowance").alias("spare"))
    wanted = written(wanted_blocks(dealt, blocks).join(spare, "query_id"), "wanted")
    return wanted, blocks, vectors, parts, bounds, queries


def share_read(queries: DataFrame, folder: str, k: int = FETCH_K) -> pd.Series:
    """How many postings of the queries' buckets there are, and how many of them a search reads in its first pass."""
    wanted, blocks, _, _, _, queries = _wanted(queries, folder, k)
    asked = vector_entries(queries, ["query_id"]).select("query_id", "bucket")
    per_bucket = blocks.groupBy("bucket").agg(F.sum("n").alias("n"))
    there = asked.join(per_bucket, "bucket").agg(F.sum("n")).first()[0] or 0
    read = wanted.agg(F.sum("n")).first()[0] or 0
    return pd.Series({"there": there, "read": read})
