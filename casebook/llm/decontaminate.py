"""Benchmark decontamination: a broadcast hash set of test windows, scanned against every document.

The windows of a block of benchmark items (`WINDOW` consecutive words, or a
shorter item whole) go to all tasks as a sorted array of hashes with a bit map
in front; a block has at most `MAX_WINDOWS` windows, so the broadcast is
bounded. Benchmarks with more windows take one scan per block, and the found
ranges are merged per document. A hash that is found is verified on the words
themselves. No text is shuffled.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casebook.llm.batches import ALNUM, Words, slices, window_hashes, words
from casebook.session import written

WINDOW = 13
#: Windows in one broadcast: about 150 bytes each, so 45 MB.
MAX_WINDOWS = 300_000
#: A document is contaminated if at least one word in this many is hit.
SHARE = 20

RESULT = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "spans array<struct<first:int,last:int>>"
)
#: What earlier blocks have found in a row.
FOUND = "array<struct<first:int,last:int,item:string>>"


class WindowSet:
    """Windows of some items: by their words, with the items they occur in, and hashes to look them up."""

    def __init__(self, items: list[tuple[str, str]]):
        self.items_of: dict[bytes, list[str]] = defaultdict(list)
        hashes: dict[int, set[int]] = defaultdict(set)
        for item_id, text in items:
            found = words(pa.array([text], pa.string()), ALNUM)
            n = len(found.hashes)
            length = min(n, WINDOW)
            if not n:
                continue
            for i, h in enumerate(window_hashes(found.hashes, length).tolist()):
                hashes[length].add(h)
                of = self.items_of[found.text(i, i + length)]
                if not of or of[-1] != item_id:
                    of.append(item_id)
        self.hashes = {n: np.sort(np.array(list(h), np.uint64)) for n, h in hashes.items()}
        self.bits = {}
        for n, h in self.hashes.items():
            self.bits[n] = np.zeros(1 << 20, bool)
            self.bits[n][(h >> np.uint64(44)).astype(np.int64)] = True

    def places(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Where a hash of the set stands in `hashes`."""
        maybe = np.flatnonzero(self.bits[length][(hashes >> np.uint64(44)).astype(np.int64)])
        known = self.hashes[length]
        at = np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)
        return maybe[known[at] == hashes[maybe]]


def window_blocks(items: DataFrame, max_windows: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of at most `max_windows` windows each (one item alone may have more).

    Items come to the driver one partition at a time, and one block is held at a time;
    a text has no more windows than half its characters. No items give one empty block.
    """
    block: list[tuple[str, str]] = []
    size = 0
    rows = items.where("text is not null and item_id is not null").select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")
    )
    for item_id, text in rows.toLocalIterator(prefetchPartitions=False):
        n = len(text) // 2 + 1
        if block and size + n > 2 * max_windows:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += n
    yield block


def _hits(known: WindowSet, found: Words) -> dict[int, set[tuple[int, int, str]]]:
    """For each text of a slice the ranges of words that a window covers, with the item."""
    hits: dict[int, set[tuple[int, int, str]]] = defaultdict(set)
    for length in known.hashes:
        at = known.places(length, window_hashes(found.hashes, length))
        doc = np.searchsorted(found.offsets, at, side="right") - 1
        inside = at + length <= found.offsets[doc + 1]
        for i, d in zip(at[inside].tolist(), doc[inside].tolist(), strict=True):
            first = i - int(found.offsets[d])
            for item in known.items_of.get(found.text(i, i + length), ()):
                hits[d].add((first, first + length, item))
    return hits


def _merged(hits: set[tuple[int, int, str]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for s, e in sorted({(s, e) for s, e, _ in hits}):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return merged


def _scanned(
    docs: DataFrame, items: DataFrame, max_windows: int, last: Callable[..., pa.RecordBatch], schema: str | StructType
) -> DataFrame:
    """Scan `docs` with each block of items; `last` turns a slice, its words and its hits into the result.

    With one block this is one pass. With more, a pass per block writes the rows with
    what has been found so far, so that one block at a time is in memory.
    """
    blocks = window_blocks(items, max_windows)
    block, following = next(blocks), next(blocks, None)
    so_far = next(n for k in range(len(docs.columns) + 1) if (n := f"found_{k}") not in docs.columns)
    if following is not None:
        docs = docs.withColumn(so_far, F.array().cast(FOUND))
    while block is not None:
        shared = docs.sparkSession.sparkContext.broadcast(WindowSet(block))
        final = following is None

        def run(
            batches: Iterator[pa.RecordBatch], shared: Broadcast = shared, final: bool = final
        ) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    found = words(part.column("text"), ALNUM)
                    hits = _hits(shared.value, found)
                    if so_far in part.schema.names:
                        for d, earlier in enumerate(part.column(so_far).to_pylist()):
                            if earlier:
                                hits[d].update((x["first"], x["last"], x["item"]) for x in earlier)
                        column = part.schema.get_field_index(so_far)
                        rows = [
                            [{"first": s, "last": e, "item": i} for s, e, i in sorted(hits.get(d, ()))]
                            for d in range(part.num_rows)
                        ]
                        part = part.set_column(column, part.schema.field(column), pa.array(rows, part.schema.field(column).type))
                    yield last(part, found, hits) if final else part

        docs = docs.mapInArrow(run, schema if final else docs.schema)
        if not final:
            docs = written(docs, "windows")
        block, following = following, None if final else next(blocks, None)
    return docs


def _counts(found: Words, hits: dict[int, set[tuple[int, int, str]]]) -> tuple[np.ndarray, np.ndarray, list]:
    n_words = np.diff(found.offsets)
    spans = [_merged(hits[d]) if d in hits else [] for d in range(len(n_words))]
    return n_words, np.array([sum(e - s for s, e in x) for x in spans], np.int64), spans


def contamination(docs: DataFrame, items: DataFrame, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): words hit by windows of `items` (item_id, text).

    `spans` are the hit ranges of words (last exclusive), merged. Words are runs of
    digits, a to z and all characters beyond ASCII, after lower-casing A-Z. A null or empty
    text has no words and is clean. Items without words, text or id give no windows;
    an empty `items` leaves everything clean. Rows with the same doc_id are judged
    each on its own, and so are items with the same text; a null doc_id passes through.
    """

    def judged(part: pa.RecordBatch, found: Words, hits: dict[int, set[tuple[int, int, str]]]) -> pa.RecordBatch:
        n_words, n_hit, spans = _counts(found, hits)
        names = [sorted({i for _, _, i in hits.get(d, ())}) for d in range(part.num_rows)]
        return pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in names], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
                pa.array((n_hit > 0) & (SHARE * n_hit >= n_words)),
                pa.array(
                    [[{"first": s, "last": e} for s, e in x] for x in spans],
                    pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])),
                ),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
        )

    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return _scanned(docs, items, max_windows, judged, RESULT)


def without_contaminated(docs: DataFrame, items: DataFrame, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """`docs` without its contaminated rows; all columns and all other rows stay as they are.

    A row is contaminated if at least one word in twenty is hit (see `contamination`).
    """
    names = docs.columns

    def kept(part: pa.RecordBatch, found: Words, hits: dict[int, set[tuple[int, int, str]]]) -> pa.RecordBatch:
        n_words, n_hit, _ = _counts(found, hits)
        return part.filter(pa.array(~((n_hit > 0) & (SHARE * n_hit >= n_words)))).select(names)

    return _scanned(docs, items, max_windows, kept, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    ).drop("spans")


SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
        FROM item_words WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, lengths WHERE len(w) >= n)
), hits AS (
  SELECT d.doc_id, d.i, d.n, item_id FROM doc_windows d JOIN item_windows b ON b.n = d.n AND b.win = d.win
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
