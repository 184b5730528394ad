"""Page documents: one record per page with its text and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.functions.text import strip
from casebook.schemas import DOCUMENT


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """Pages with text; blank pages can never yield a chunk and are dropped.

    Files without a page column hold documents of one page, number 0.
    """
    pages = spark.read.schema(DOCUMENT).parquet(path).withColumn("page", F.coalesce("page", F.lit(0).cast("bigint")))
    return pages.filter(strip(F.col("text")) != "")


def load_text_pages(spark: SparkSession, path: str, page_break: str = "\f") -> DataFrame:
    """Extracted text files, one per document, with pages parted by form feeds.

    Returns (doc_id, source, page, text), pages counted from 0. The id is a 64-bit
    hash of the file's path, so it stays the same when files are added.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), F.col("value")
    )
    return files.select(
        F.xxhash64("source").alias("doc_id"), "source", F.posexplode(F.split("value", page_break, -1)).alias("page", "text")
    ).withColumn("page", F.col("page").cast("bigint")).filter(strip(F.col("text")) != "")
