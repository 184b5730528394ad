"""The persisted chunk collection: Parquet with text, metadata and vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLLECTION = "docs"


def collection_path(folder: str, name: str = COLLECTION) -> str:
    return f"{folder.rstrip('/')}/{name}"


def write_collection(chunks: DataFrame, folder: str, name: str = COLLECTION) -> str:
    path = collection_path(folder, name)
    chunks.write.mode("overwrite").parquet(path)
    return path


def open_collection(
    spark: SparkSession, folder: str, columns: list[str] | None = None, name: str = COLLECTION
) -> DataFrame:
    """Name the columns needed: the vector column is by far the widest."""
    stored = spark.read.parquet(collection_path(folder, name))
    return stored.select(*columns) if columns else stored


def missing_chunks(batch: DataFrame, stored: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of a batch that the collection does not hold yet."""
    return batch.join(stored.select(key), key, "left_anti")


def append_collection(batch: DataFrame, folder: str, name: str = COLLECTION) -> None:
    """Add only new chunks, so that indexing a document again changes nothing."""
    spark = batch.sparkSession
    new = missing_chunks(batch, open_collection(spark, folder, ["chunk_id"], name))
    new.write.mode("append").parquet(collection_path(folder, name))
