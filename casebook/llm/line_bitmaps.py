"""Lines that recur across documents, with DataFrame functions only.

Every line is a row (hash, document, place). The rows are dealt out by ranges of
(hash, document, place) and sorted so within each part; one pass over the sorted rows
marks where a line occurs first in a document. A line of very many documents so is
many ranges, and the first occurrences of a part are added up before they meet those
of other parts. What comes back is no text: each document with dropped lines gets a
run-length coded bitmap of them, from which the kept text follows.

A document is a distinct pair of doc_id and text: a repeated row counts once and
gets the same bitmap; rows of one doc_id with different texts are two documents, and
so are different texts without an id. Lines are compared by 96 bits of hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.session import written

#: What is stripped from both ends of a line: 0x20 and 0x09 to 0x0D.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The registered rule: keys of at least this many code points, in at least this many documents.
MIN_CHARS, MIN_DOCUMENTS = 1, 10
LINE = ["h1", "h2"]
DOCUMENT = ["d", "t"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def lines(text: Column) -> Column:
    """The lines of a text; null and empty have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _document() -> list[Column]:
    """What tells documents apart: the id, or the text's hash without one; and a second hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [
        F.coalesce(F.col("doc_id"), F.xxhash64(text)).alias("d"),
        F.hash(F.col("doc_id").isNull(), text).alias("t"),
    ]


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def first_occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, d, t, at, first): the lines of all documents in order of hash, document and place.

    `first` marks the first of a line's occurrences in its document. `at` counts from 0.
    """
    placed = _own(docs).select(*_document(), F.posexplode(lines(F.col("text"))).alias("at", "line"))
    keyed = placed.select("d", "t", "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    # Written, as the bounds of the ranges are found by a pass of its own.
    hashed = written(keyed.select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), *DOCUMENT, "at"), "lines")
    in_order = hashed.repartitionByRange(*LINE, *DOCUMENT).sortWithinPartitions(*LINE, *DOCUMENT, "at")
    stream = Window.partitionBy(*LINE, *DOCUMENT).orderBy("at")
    return in_order.withColumn("first", F.row_number().over(stream) == 1)


def dropped_lines(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, *, keep_first: bool = False
) -> DataFrame:
    """(d, t, at) of the lines whose key at least `min_documents` documents hold.

    `keep_first` keeps one line of each key: the first by document (smallest d, then t) and place.
    """
    occurrences = first_occurrences(docs, min_chars)
    best = F.min(F.struct(*DOCUMENT, "at")).alias("best")
    frequent = occurrences.where("first").groupBy(*LINE).agg(F.count("*").alias("n"), best).where(F.col("n") >= min_documents)
    # Written, so that its size decides how it meets the lines, and a line of very many documents can be split there.
    frequent = written(frequent, "frequent")
    hits = occurrences.drop("first").join(frequent, LINE)
    if keep_first:
        hits = hits.where(F.struct(*DOCUMENT, "at") != F.col("best"))
    return hits.select(*DOCUMENT, "at")


def _coded(runs: Column) -> Column:
    """Runs (at, n) as binary: four bytes of place and four of length each."""
    four = lambda c: F.lpad(F.hex(c), 8, "0")
    return F.unhex(F.array_join(F.transform(runs, lambda r: F.concat(four(r["at"]), four(r["n"]))), ""))


def _decoded(bitmap: Column) -> Column:
    number = lambda text: F.conv(text, 16, 10).cast("int")
    return F.transform(
        F.regexp_extract_all(F.hex(bitmap), F.lit(".{16}"), F.lit(0)),
        lambda x: F.struct(number(F.left(x, F.lit(8))).alias("at"), number(F.right(x, F.lit(8))).alias("n")),
    )


def bitmaps(dropped: DataFrame) -> DataFrame:
    """(d, t, n_dropped, bitmap) of every document with dropped lines.

    The bitmap holds its runs of dropped lines, in order. Runs are found by windows and
    aggregates, so a document with very many of them costs no more per line.
    """
    island = Window.partitionBy(*DOCUMENT).orderBy("at")
    runs = (
        dropped.distinct()
        .withColumn("island", F.col("at") - F.row_number().over(island))
        .groupBy(*DOCUMENT, "island")
        .agg(F.min("at").alias("at"), F.count("*").cast("int").alias("n"))
    )
    return (
        runs.groupBy(*DOCUMENT)
        .agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("runs"), F.sum("n").cast("long").alias("n_dropped"))
        .select(*DOCUMENT, "n_dropped", _coded(F.col("runs")).alias("bitmap"))
    )


def kept_text(text: Column, bitmap: Column) -> Column:
    """The lines of a text that the bitmap does not drop, joined by line feeds; all of them without a bitmap."""
    none = F.array().cast("array<int>")

    def places(runs: Column) -> Column:
        """The places of kept lines: those between the runs."""
        n = F.size(lines(text))
        ends = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["at"] + r["n"]))
        starts = F.concat(F.transform(runs, lambda r: r["at"]), F.array(n))
        gaps = F.arrays_zip(ends.alias("a"), starts.alias("b"))
        return F.flatten(F.transform(gaps, lambda g: F.when(g["b"] > g["a"], F.sequence(g["a"], g["b"] - 1)).otherwise(none)))

    def joined(line: Column) -> Column:
        return F.array_join(F.transform(let(_decoded(bitmap), places), lambda i: F.get(line, i)), "\n")

    return F.when(bitmap.isNull(), F.coalesce(text, F.lit(""))).otherwise(let(lines(text), joined))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def line_bitmaps(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, *, keep_first: bool = False
) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, text, n_lines, n_dropped, bitmap (null where nothing goes).

    A null text has one empty line, which no key of a character or more can drop.
    Repeated rows get the same bitmap; other columns are left out.
    """
    marks = bitmaps(dropped_lines(docs, min_documents, min_chars, keep_first=keep_first))
    rows = _own(docs).select("doc_id", "text", F.size(lines(F.col("text"))).cast("long").alias("n_lines"), *_document())
    return rows.join(marks, DOCUMENT, "left").select(
        "doc_id", "text", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "bitmap"
    )


def without_frequent_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) for every row."""
    return line_bitmaps(docs, min_documents, min_chars).select(
        "doc_id", "n_lines", "n_dropped", kept_text(F.col("text"), F.col("bitmap")).alias("kept_text")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_frequent_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


SQL = f"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
), frequent AS (
  SELECT key FROM l WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}
)
SELECT l.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN frequent f ON f.key = l.key GROUP BY l.doc_id
"""
