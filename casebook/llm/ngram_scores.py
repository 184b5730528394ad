"""Stupid-backoff scores of every document under an n-gram model of all other documents.

With counts c' over all documents but the word's own, and u the up to n - 1 words
before w in its document,

    S(w | u) = c'(u w) / c'(u)            if c'(u w) > 0,
               0.4 * S(w | u without its first word)   otherwise
    S(w)     = c'(w) / N'

and a document's score is the mean of ln S over its words (a word that no other
document has counts as half an occurrence). A document's first words have shorter u.

Relationally this is: n-grams of the documents exploded and counted, counts summed
by n-gram, joined back, summed per document. A row per n-gram would be most of the
work, so rows carry packed arrays: documents lie in blocks of about `BLOCK_BYTES` of
text (a longer text is a block of its own), compressed, a row each. A block's distinct
n-grams of all lengths are sorted by hash and cut into hash partitions ("buckets"),
one row each. Each bucket adds up its rows of all blocks into its part of the count
table and hands every block's counts back to it. An n-gram is one entry of a block
however often it occurs there, so a frequent one makes no hot key, and buckets
multiply with the input, so that a bucket's part of the table stays of one size. The
tables hold every n-gram; nothing is cut off. A block has millions of n-grams, so a
packed row holds some hundred of them at 100 GB of text and some ten at 1 TB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm.batches import NOT_SPACE, mix, slices, words
from casebook.session import written

BACKOFF = 0.4
UNSEEN = 0.5
#: Longest n-gram of the registered model.
ORDER = 3
#: Bytes of text in a block; a task holds one block's n-grams at a time.
BLOCK_BYTES = 8 << 20
#: Bytes of text for each bucket, so that a bucket's entries fit in a task; and the fewest buckets.
BUCKET_BYTES, MIN_BUCKETS, MAX_BUCKETS = 8 << 20, 64, 1 << 24
#: Compression of the texts, which are written and shuffled once.
TEXT_LEVEL = 9
#: Hashes are cut to this many bits to pack well.
HASH_BITS = 56

GRAMS = "block long, bucket int, grams binary, counts binary"


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, so that the upper planes compress to little: width, length, compressed planes."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _wide(data: bytes) -> np.ndarray:
    width, size = data[0], int.from_bytes(data[1:9], "little")
    wide = np.zeros((size // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(pa.decompress(data[9:], size, "zstd"), np.uint8).reshape(width, -1).T
    return wide.reshape(-1)


def pack(values: np.ndarray) -> bytes:
    """Sorted numbers as their differences."""
    return _planes(np.diff(values, prepend=np.uint64(0)))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_wide(data).view("<u8"), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    return _planes(values)


def unpack_counts(data: bytes) -> np.ndarray:
    return _wide(data).view("<i8")


def grams_of(column: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each length up to `order` the hashes of the n-grams that end at each word (0 where the text is too short), and text offsets."""
    found = words(column, NOT_SPACE)
    shift = np.uint64(64 - HASH_BITS)
    n_words = np.diff(found.offsets)
    place = np.arange(len(found.hashes)) - np.repeat(found.offsets[:-1], n_words)
    out, longer = [found.hashes >> shift], found.hashes
    for n in range(2, order + 1):
        before, longer = longer, np.zeros(len(found.hashes), np.uint64)
        with np.errstate(over="ignore"):
            longer[1:] = mix(before[:-1] * np.uint64(0x9E3779B97F4A7C15) + found.hashes[1:])
        longer[place < n - 1] = 0
        out.append(longer >> shift)
    return out, found.offsets


def _all_grams(parts: list[pa.RecordBatch], order: int) -> np.ndarray:
    """Hashes of all n-grams of a block, one for each occurrence."""
    found = [g[g > 0] for part in parts for g in grams_of(part.column("text"), order)[0]]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums of counted sets by n-gram, and where each set's entries stand in them."""
    values, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]), minlength=len(values)).astype(np.int64)
    ends = np.cumsum([len(p[0]) for p in parts])
    return total, np.split(inverse, ends[:-1])


def _closed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """A block as one row: its documents as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=TEXT_LEVEL))
    with pa.ipc.new_stream(sink, parts[0].schema, options=options) as stream:
        stream.write_table(pa.Table.from_batches(parts).combine_chunks())
    texts = [t for part in parts for t in part.column("text").to_pylist()]
    sizes = [pa.array([x], pa.int64()) for x in (sum(len(t.encode()) for t in texts), sum(len(t.encode().split(None)) for t in texts))]
    return pa.RecordBatch.from_arrays([*sizes, pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["n_bytes", "n_words", "docs"])


def _opened(block: bytes) -> list[pa.RecordBatch]:
    return [part for batch in pa.ipc.open_stream(block) for part in slices(batch, "text")]


def in_blocks(docs: DataFrame) -> DataFrame:
    """The documents in numbered blocks, written once so that they stay the same in both passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                n_bytes = sum(pc.binary_length(part.column("text")).to_pylist())
                if parts and size + n_bytes > BLOCK_BYTES:
                    yield _closed(parts)
                    parts, size = [], 0
                parts.append(part)
                size += n_bytes
        if parts:
            yield _closed(parts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = rows.mapInArrow(run, "n_bytes long, n_words long, docs binary").withColumn("block", F.monotonically_increasing_id())
    return written(blocks, "blocks")


def _block_grams(blocks: DataFrame, buckets: int, order: int) -> DataFrame:
    """One row per block and bucket: its distinct n-grams and their counts."""
    shift = np.uint64(HASH_BITS - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, docs in zip(batch.column("block").to_pylist(), batch.column("docs"), strict=True):
                values, counts = np.unique(_all_grams(_opened(docs.as_buffer()), order), return_counts=True)
                ends = np.searchsorted(values >> shift, np.arange(buckets + 1))
                filled = np.flatnonzero(np.diff(ends))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(filled), block), pa.int64()),
                        pa.array(filled, pa.int32()),
                        pa.array([pack(values[ends[b] : ends[b + 1]]) for b in filled], pa.binary()),
                        pa.array([pack_counts(counts[ends[b] : ends[b + 1]]) for b in filled], pa.binary()),
                    ],
                    names=["block", "bucket", "grams", "counts"],
                )

    return blocks.select("block", "docs").mapInArrow(run, GRAMS)


def _totals(grams: DataFrame) -> DataFrame:
    """The count tables: each bucket adds up its rows and hands every block the totals of its n-grams.

    The totals are in the order of the block's n-grams of that bucket, which the block
    knows itself, so the n-grams do not travel back.
    """

    def run(table: pa.Table) -> pa.Table:
        parts = [
            (unpack(g), unpack_counts(c))
            for g, c in zip(table.column("grams").to_pylist(), table.column("counts").to_pylist(), strict=True)
        ]
        total, places = _added(parts)
        return pa.table(
            {
                "block": table.column("block"),
                "bucket": table.column("bucket"),
                "counts": pa.array([pack_counts(total[p]) for p in places], pa.binary()),
            }
        )

    return grams.groupBy("bucket").applyInArrow(run, "block long, bucket int, counts binary")


def ngram_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per row of `docs` (doc_id, text): n_words, n_backoff, score.

    Words are runs of all but ASCII white space, A-Z in lower case; n-grams have up to
    `order` words. `n_backoff` counts words after the first whose longest n-gram (of
    `order` words, or from the document's first word on) no other document has. A null or empty
    text has no words and score 0. Every row is a document of its own, so repeated
    rows count for each other; a null doc_id passes through.
    """
    if order < 1:
        raise ValueError("order has to be 1 or more")
    blocks = in_blocks(docs)
    size, total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    buckets = MIN_BUCKETS
    while buckets < MAX_BUCKETS and buckets * BUCKET_BYTES < size:
        buckets *= 2
    totals = _totals(_block_grams(blocks, buckets, order))
    shift = np.uint64(HASH_BITS - (buckets.bit_length() - 1))

    def scored(key: object, own: pa.Table, counts: pa.Table) -> pa.Table:
        parts = _opened(own.column("docs")[0].as_buffer())
        found = [grams_of(part.column("text"), order) for part in parts]
        values = np.concatenate([g for of_part, _ in found for g in of_part])
        there = np.flatnonzero(values)
        grams, inverse = np.unique(values[there], return_inverse=True)
        # Each n-gram's place in the block's table, -1 for none, cut into parts and lengths again.
        places = np.full(len(values), -1, np.int64)
        places[there] = inverse
        places = np.split(places, np.cumsum([len(g) for of_part, _ in found for g in of_part])[:-1])
        ends = np.searchsorted(grams >> shift, np.arange(buckets + 1))
        tally = np.zeros(len(grams), np.int64)
        for b, c in zip(counts.column("bucket").to_pylist(), counts.column("counts").to_pylist(), strict=True):
            tally[ends[b] : ends[b + 1]] = unpack_counts(c)
        return pa.Table.from_batches([
            _score(part, places[i * order : (i + 1) * order], offsets, tally, total)
            for i, (part, (_, offsets)) in enumerate(zip(parts, found, strict=True))
        ])

    return (
        blocks.select("block", "docs")
        .groupBy("block")
        .cogroup(totals.groupBy("block"))
        .applyInArrow(scored, "doc_id long, n_words long, n_backoff long, score double")
    )


def _others(places: np.ndarray, doc: np.ndarray, tally: np.ndarray) -> np.ndarray:
    """Occurrences in all other documents; 0 where there is no n-gram."""
    out = np.zeros(len(places), np.int64)
    there = np.flatnonzero(places >= 0)
    # Places fit in 40 bits and a slice's documents in 23.
    both = (doc[there] << 40) | places[there]
    known, counts = np.unique(both, return_counts=True)
    out[there] = tally[places[there]] - counts[np.searchsorted(known, both)]
    return out


def _score(part: pa.RecordBatch, places: list[np.ndarray], offsets: np.ndarray, tally: np.ndarray, total: int) -> pa.RecordBatch:
    n_words = np.diff(offsets)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    count = _others(places[0], doc, tally)
    value = np.log(np.maximum(count, UNSEEN)) - np.log(np.maximum(total - n_words, 1)[doc])
    backed = np.zeros(len(doc), bool)
    for longer in places[1:]:
        # The n-gram's first words are the shorter n-gram that ends one word earlier.
        before = np.concatenate([[1], count[:-1]])[: len(count)]
        count = _others(longer, doc, tally)
        there = longer >= 0
        backed = np.where(there, count <= 0, backed)
        ratio = np.log(np.maximum(count, 1)) - np.log(np.maximum(before, 1))
        value = np.where(there, np.where(count > 0, ratio, value + np.log(BACKOFF)), value)
    sums = np.bincount(doc, weights=value, minlength=len(n_words))
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id"),
            pa.array(n_words, pa.int64()),
            pa.array(np.bincount(doc, weights=backed, minlength=len(n_words)).astype(np.int64)),
            pa.array(np.round(sums / np.maximum(n_words, 1), 6)),
        ],
        names=["doc_id", "n_words", "n_backoff", "score"],
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), t AS (
  SELECT doc_id, len(words) AS n_words, i, words[i] AS w, CASE WHEN i > 1 THEN words[i - 1] END AS v, CASE WHEN i > 2 THEN words[i - 2] END AS u
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d)
), c AS (
  SELECT *, count(*) OVER () - n_words AS n,
    count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
    count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) AS c2,
    count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY doc_id, u, v, w) AS c3
  FROM t
), l AS (
  SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS before1, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS before2,
    ln(greatest(c1, 0.5)) - ln(greatest(n, 1)) AS x1
  FROM c
), m AS (
  SELECT *, CASE WHEN v IS NULL THEN x1 WHEN c2 > 0 THEN ln(c2) - ln(greatest(before1, 1)) ELSE x1 + ln(0.4) END AS x2 FROM l
), s AS (
  SELECT doc_id, v IS NOT NULL AND CASE WHEN u IS NULL THEN c2 ELSE c3 END <= 0 AS backed,
    CASE WHEN u IS NULL THEN x2 WHEN c3 > 0 THEN ln(c3) - ln(greatest(before2, 1)) ELSE x2 + ln(0.4) END AS x
  FROM m
), r AS (
  SELECT doc_id, count(*) FILTER (WHERE backed) AS n_backoff, sum(x) AS x FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(d.words), 0) AS n_words, CAST(coalesce(n_backoff, 0) AS BIGINT) AS n_backoff,
  coalesce(round(x / len(d.words), 6), 0) AS score
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""
