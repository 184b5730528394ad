"""Documents to chunks to vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.fixed_values import CHUNK_OVERLAP, CHUNK_SIZE
from casebook.functions.chunking import fixed_chunks, recursive_chunks
from casebook.functions.vectors import HASH_DIM, hashed_vector
from casebook.operators.ordering import spread

KEYS = ("doc_id", "page", "chunk_no")


def chunk_id() -> Column:
    """What identifies a chunk: its document, page and number. Compares field by field."""
    return F.struct(*(F.col(c).cast("bigint").alias(c) for c in KEYS))


def chunk_documents(
    documents: DataFrame,
    method: str = "recursive",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """One row per chunk; every other document column is inherited.

    A document without a page column, or with a null in it, is page 0. Pages of one
    document share its doc_id and are told apart by their number.
    """
    cut = recursive_chunks if method == "recursive" else fixed_chunks
    page = F.coalesce(F.col("page"), F.lit(0)) if "page" in documents.columns else F.lit(0)
    inherited = [c for c in documents.columns if c not in ("text", *KEYS, "chunk_id")]
    parts = spread(documents).select(
        "doc_id", page.cast("bigint").alias("page"), *inherited, F.posexplode(cut(F.col("text"), size, overlap)).alias("chunk_no", "text")
    )
    return parts.withColumn("chunk_no", F.col("chunk_no").cast("bigint")).select(
        chunk_id().alias("chunk_id"), *KEYS, "text", *inherited
    )


def embed_hashed(df: DataFrame, text: str = "text", dim: int = HASH_DIM, name: str = "vec") -> DataFrame:
    """Deterministic feature hashing, unit norm, inside the row."""
    return df.withColumn(name, hashed_vector(F.col(text), dim))


def embed_with(
    df: DataFrame,
    make_model: Callable[[], Callable[[list[str]], list[list[float]]]],
    text: str = "text",
    name: str = "vec",
) -> DataFrame:
    """Plug in a model: it is built once per task and called on batches of texts."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for batch in batches:
            yield pd.Series(list(model(batch.tolist())))

    return df.withColumn(name, encode(F.col(text)))


def vector_entries(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Long form of a sparse vector: one row per (keys, bucket, weight)."""
    entry = F.explode(F.arrays_zip(F.col(f"{vec}.idx"), F.col(f"{vec}.val"))).alias("_e")
    return df.select(*keys, entry).select(
        *keys, F.col("_e.idx").cast("bigint").alias("bucket"), F.col("_e.val").alias("weight")
    )
