"""Near duplicates by MinHash bands and sequential Bayesian verification.

A document is its set of distinct 5-word shingles; documents are linked if the
sets' Jaccard similarity is at least 3/4. The steps:

1. One pass over the texts gives a fingerprint of each set, its size, `BANDS` band
   keys of `ROWS` minima each, and four bits of each of the 768 minima.
2. Documents with equal sets form a class, and only its smallest id goes on.
3. Rounds over the bands' buckets. The first two pair each member of a bucket with
   one pivot only, so a group of copies costs as many pairs as it has members.
   What is in one component then needs no further pair; the last round pairs all
   members of a bucket that are still in different components, each pair in the
   first band that it shares.
4. A pair's minima are compared in batches. After each batch the pair goes if the
   posterior probability of a similarity of 3/4 or more, from a uniform prior, is
   below `MISS`. The survivors are verified on the full sets.

A linked pair is missed by all bands with probability (1 - 0.75^5)^51 = 1e-6 at
the threshold itself, and less above it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.llm.batches import MIX_1, NOT_SPACE, mix, slices, window_hashes, words
from casebook.llm.components import components
from casebook.session import written

SHINGLE = 5
BANDS, ROWS = 51, 5
MINIMA, BITS = 768, 4
#: Minima in a 64-bit number, and in how many such numbers each batch of the comparison ends.
PACKED = 64 // BITS
BATCH_ENDS = (2, 6, 48)
#: Probability at which a pair that is linked may be given up in a batch.
MISS = 1e-5
#: Ids that may be broadcast to pick documents: 16 bytes each, so 32 MB.
MAX_BROADCAST_IDS = 2_000_000
#: Pivots that a document is verified against in the second round, best signature first.
SECOND_PIVOTS = 3

_SEEDS = mix(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64) * MIX_1)
FACTORS, SHIFTS = _SEEDS[:MINIMA].astype(np.uint32) | np.uint32(1), _SEEDS[MINIMA:].astype(np.uint32)

SIGNATURE = "doc_id long, n_shingles long, print_a long, print_b long, bands array<long>, bits array<long>"


def shingle_sets(part: pa.RecordBatch) -> Iterator[np.ndarray]:
    """For each text of a slice its distinct shingles as sorted 64-bit hashes."""
    found = words(part.column("text"), NOT_SPACE)
    shingles = window_hashes(found.hashes, SHINGLE)
    for first, last in zip(found.offsets[:-1].tolist(), found.offsets[1:].tolist(), strict=True):
        n = last - first
        if n >= SHINGLE:
            yield np.unique(shingles[first : last - SHINGLE + 1])
        else:
            yield window_hashes(found.hashes[first:last], n) if n else np.zeros(0, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """768 minima of the set under as many hash functions, half of them on each half of the hash."""
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    halves = ((shingles >> np.uint64(32)).astype(np.uint32), shingles.astype(np.uint32))
    for k, half in enumerate(halves):
        own = slice(k * MINIMA // 2, (k + 1) * MINIMA // 2)
        for start in range(0, len(half), 2048):
            x = half[start : start + 2048, None] * FACTORS[None, own] + SHIFTS[None, own]
            x ^= x >> np.uint32(15)
            out[own] = np.minimum(out[own], x.min(axis=0))
    return out


def _signed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.arange(PACKED, dtype=np.uint64) * np.uint64(BITS)
        numbers = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, prints, bands, bits = [], [], [], []
                for shingles in shingle_sets(part):
                    sizes.append(len(shingles))
                    with np.errstate(over="ignore"):
                        prints.append((shingles.sum(dtype=np.uint64), mix(shingles ^ MIX_1).sum(dtype=np.uint64)))
                    if not len(shingles):
                        bands.append(None)
                        bits.append(None)
                        continue
                    low = minima(shingles)
                    wide = low[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
                    key = numbers.copy()
                    for r in range(ROWS):
                        key = mix(key ^ wide[:, r]) + key
                    bands.append(mix(key).view(np.int64))
                    nibbles = (mix(low.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).reshape(-1, PACKED)
                    bits.append((nibbles << places).sum(axis=1, dtype=np.uint64).view(np.int64))
                prints = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(sizes, pa.int64()),
                        pa.array(prints[:, 0].copy()),
                        pa.array(prints[:, 1].copy()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(bits, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "print_a", "print_b", "bands", "bits"],
                )

    return docs.mapInArrow(run, SIGNATURE)


@cache
def fewest_matches(seen: int, miss: float = MISS) -> int:
    """Least number of equal minima in `seen` at which the pair goes on.

    Of similarity s, the kept bits of two minima are equal with probability
    s + (1 - s) / 2 ** BITS. With a uniform prior on s, the posterior of s >= 3/4 is a
    ratio of two integrals, taken here on a grid.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    chance = grid + (1 - grid) / 2**BITS
    equal, differ = np.log(chance), np.log(1 - chance)
    for m in range(seen + 1):
        weight = m * equal + (seen - m) * differ
        weight = np.exp(weight - weight.max())
        if weight[grid >= 0.75].sum() >= miss * weight.sum():
            return m
    return seen


ONES = sum(1 << (BITS * i) for i in range(PACKED))


def _differ(x: Column, y: Column) -> Column:
    """How many of the minima packed in two numbers differ."""
    x = x.bitwiseXOR(y)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(ONES)))


def _equal(a: str, b: str, end: int) -> Column:
    """Equal minima in the first `end` packed numbers."""
    left, right = F.col(f"{a}.bits"), F.col(f"{b}.bits")
    if end <= 6:  # as one expression; more would make too large a method
        return F.lit(end * PACKED) - sum((_differ(F.get(left, F.lit(k)), F.get(right, F.lit(k))) for k in range(1, end)), _differ(left[0], right[0]))
    return F.lit(end * PACKED) - F.aggregate(F.zip_with(left, right, _differ), F.lit(0), lambda n, x: n + x)


def likely(a: str, b: str) -> Column:
    """Sizes that allow the similarity, and minima that keep its posterior at MISS or more after each batch."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    tests = [F.lit(100) * F.least(n_a, n_b) >= F.lit(75) * F.greatest(n_a, n_b)]
    tests += [_equal(a, b, end) >= fewest_matches(end * PACKED) for end in BATCH_ENDS]
    return reduce(lambda x, y: x & y, tests)


def picked(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of `docs` whose doc_id is (or, left_anti, is not) in `ids`; the ids are broadcast only if few."""
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", how)


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [x.view(np.int64) for x in shingle_sets(part)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(rows, pa.list_(pa.int64()))], names=["id", "shingles"]
                )

    return picked(docs, ids).mapInArrow(run, "id long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= 75 * union."""
    pairs = written(pairs, "candidates")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    used = picked(sets.withColumnRenamed("id", "doc_id"), ids)
    with_a = pairs.join(used.selectExpr("doc_id a", "shingles left_set"), "a")
    both = with_a.join(used.selectExpr("doc_id b", "shingles right_set"), "b")
    common = F.size(F.array_intersect("left_set", "right_set"))
    return both.where(F.lit(100) * common >= F.lit(75) * (F.size("left_set") + F.size("right_set") - common)).select("a", "b")


def _with_bits(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs (a, b) that may be linked, with the number of equal bits."""
    left = bits.select(F.col("id").alias("a"), F.struct("n", "bits").alias("x"))
    right = bits.select(F.col("id").alias("b"), F.struct("n", "bits").alias("y"))
    return (
        pairs.join(left, "a").join(right, "b").where(likely("x", "y")).select("a", "b", _equal("x", "y", MINIMA // PACKED).alias("equal"))
    )


def _same(x: Column, y: Column) -> Column:
    return F.when(x == y, x)


def _best(pairs: DataFrame, n: int) -> DataFrame:
    """For each b its n partners with the most equal bits."""
    order = Window.partitionBy("b").orderBy(F.desc("equal"), "a")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("a", "b")


def class_links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between class representatives that connect all that are linked.

    `reps` has one row per class: id, n, bands, bits.
    """
    bits = reps.drop("bands")
    rows = reps.select("id", F.explode("bands").alias("key"))
    shared = written(
        rows.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("members")).where("members > 1").select("key", "pivot"),
        "buckets",
    )
    # Members of buckets with company, by bucket; all later rounds read this.
    members = written(rows.join(shared, "key").select("key", "id", "pivot"), "members")
    first = _with_bits(members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), bits)
    first = written(first, "pairs")
    ids = written(members.select(F.col("id").alias("doc_id")).distinct(), "ids")
    sets = written(_sets(docs, ids), "sets")
    links = written(_verified(_best(first, 1), sets), "links")
    for last in (False, True):
        found = components(links) if links.limit(1).count() else links.selectExpr("a id", "b component")
        placed = members.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        # The bucket's pivot component is that of a member picked by hash, another one in each band.
        pick = F.struct(F.xxhash64("id", "key"), F.col("id"), F.col("component"))
        buckets = (
            placed.groupBy("key")
            .agg(F.min(pick).alias("p"), F.min("component").alias("lo"), F.max("component").alias("hi"))
            .where("lo <> hi")
            .select("key", F.col("p.id").alias("pivot"), F.col("p.component").alias("main"))
        )
        open_rows = placed.join(buckets, "key")
        if last:
            open_rows = written(open_rows.join(reps, "id"), "open")
            side = open_rows.select("key", "main", "component", "id", "bands", F.struct("n", "bits").alias("x"))
            out, every = side.where("component <> main").alias("o"), side.alias("e")
            pairs = (
                out.join(
                    every.withColumnRenamed("x", "y").alias("e"),
                    (F.col("o.key") == F.col("e.key"))
                    & (F.col("o.component") != F.col("e.component"))
                    & ((F.col("e.component") == F.col("e.main")) | (F.col("o.id") < F.col("e.id")))
                    & likely("x", "y")
                    & (F.col("o.key") == F.get(F.filter(F.zip_with("o.bands", "e.bands", _same), F.isnotnull), F.lit(0))),
                )
                .select(F.col("o.id").alias("a"), F.col("e.id").alias("b"))
                .distinct()
            )
        else:
            pairs = _best(
                _with_bits(
                    open_rows.where("component <> main").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), bits
                ),
                SECOND_PIVOTS,
            )
        links = links.union(written(_verified(pairs, sets), "links"))
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): n_shingles, component_id, kept.

    Words are runs of all but ASCII white space, A-Z in lower case. `component_id`
    is the smallest doc_id that links lead to, the own one included; `kept` marks
    it. Without words (null, empty or blank text) nothing is linked; with fewer than
    five words the whole sequence is the one shingle. Rows with the same doc_id are
    each taken with their own text and count as one node of the graph. A row with a
    null doc_id has no links: its component is null and it is kept.
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    signed = written(_signed(docs), "signatures")
    prints = ["n_shingles", "print_a", "print_b"]
    classes = written(
        signed.where("doc_id is not null and n_shingles > 0")
        .groupBy(*prints)
        .agg(F.min("doc_id").alias("id"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("bits", "doc_id").alias("bits")),
        "classes",
    )
    links = class_links(docs, classes.select("id", F.col("n_shingles").alias("n"), "bands", "bits"))
    members = written(
        signed.select("doc_id", *prints).join(classes.select("id", *prints), prints, "left").select("doc_id", "n_shingles", "id"),
        "members",
    )
    # A doc_id that stands for several sets ties their classes together.
    several = members.groupBy("doc_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("doc_id")
    ties = members.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    links = written(links.union(ties.where("b is not null")), "links")
    found = components(links).withColumnRenamed("id", "class")
    return members.join(found, members["id"] == found["class"], "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", members["id"], "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", members["id"], "doc_id"), F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each group, that with the smallest doc_id; all columns stay.

    Rows without words or without a doc_id stay. Rows with the same doc_id are one
    document: they stay or go together.
    """
    dropped = written(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "dropped")
    return picked(docs, dropped, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(len(w), 5) - 1], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), walk AS (
  SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT walk.id, links.b FROM walk JOIN links ON links.a = walk.seen
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(walk.seen) AS component_id, d.doc_id = min(walk.seen) AS kept
FROM documents d JOIN walk ON walk.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

