"""A chunk collection that follows its documents: changed ones are replaced, vanished ones go.

Chunks lie in buckets by a hash of their document's id. Every row carries the digest
of the document it was cut from, so one pass over two narrow columns tells which
documents of a batch differ, and only the buckets of these are written again
(dynamic partition overwrite). Indexing the same documents again writes nothing. A
commit replaces bucket after bucket: if it is cut off, indexing the whole source
again finds what is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.fixed_values import CHUNK_OVERLAP, CHUNK_SIZE
from casebook.operators.indexing import chunk_documents
from casebook.session import written

#: Documents that a bucket is meant for when a collection begins; at least MIN_BUCKETS of them.
PER_BUCKET, MIN_BUCKETS = 20_000, 16
OWN = ("digest", "run", "buckets", "bucket")


def digests(documents: DataFrame, settings: str) -> DataFrame:
    """(doc_id, digest): all rows of a document, in any order, and how they are cut.

    Sums of row hashes, so that a document of very many pages is added up before it moves.
    """
    names = sorted(documents.columns)
    row = [F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), F.lit(settings)]
    sums = [F.sum(F.xxhash64(*row, F.lit(salt)).cast("decimal(20,0)")).cast("string") for salt in (1, 2)]
    return documents.groupBy("doc_id").agg(F.concat_ws("/", F.count("*").cast("string"), *sums).alias("digest"))


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _bucket(buckets: Column) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), buckets).cast("int")


def open_replacing(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks, with the run that wrote each. Open it again after a run: buckets are replaced under older readers."""
    return spark.read.parquet(folder).where("chunk_no is not null").drop("digest", "buckets", "bucket")


def index_documents(
    documents: DataFrame, folder: str, whole: bool = True, method: str = "recursive", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Bring the collection in line with the documents; returns (doc_id, change): new, changed or vanished.

    With ``whole`` the documents are the whole source, and stored ones that are
    missing from it vanish; without it they stay. Rows without a doc_id are left
    out. Columns and their types stay as at the first run; the names digest, run,
    buckets and bucket are taken.
    """
    spark = documents.sparkSession
    taken = [c for c in documents.columns if c.lower() in OWN]
    if taken:
        raise ValueError(f"columns {taken} are taken by the collection")
    documents = documents.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    incoming = digests(documents, f"{method} {size} {overlap}").withColumnRenamed("digest", "incoming")
    begun = _exists(spark, folder)
    if begun:
        stored = spark.read.parquet(folder)
        head = stored.agg(F.max("buckets"), F.max("run")).first()
        buckets, run = head[0], head[1] + 1
        held = stored.where("digest is not null").select("doc_id", "digest").distinct()
    else:
        buckets, run = max(MIN_BUCKETS, -(-documents.count() // PER_BUCKET)), 1
        held = spark.createDataFrame([], "doc_id bigint, digest string")
    change = (
        F.when(F.col("digest").isNull(), "new").when(F.col("incoming").isNull(), "vanished").when(F.col("incoming") != F.col("digest"), "changed")
    )
    decisions = incoming.join(held, "doc_id", "full").select("doc_id", "incoming", change.alias("change")).where("change is not null")
    if not whole:
        decisions = decisions.where("change <> 'vanished'")
    decisions = written(decisions.withColumn("bucket", _bucket(F.lit(buckets))), "decisions")
    if not decisions.limit(1).count() and begun:
        return decisions.select("doc_id", "change")

    fresh = decisions.where("incoming is not null").select("doc_id", F.col("incoming").alias("digest"))
    chunks = chunk_documents(documents.join(fresh.select("doc_id"), "doc_id", "left_semi"), method, size, overlap).drop("chunk_id")
    # A document without chunks, and a bucket that runs empty, keep a row without number: known, and no old file stays.
    marks = fresh.select("doc_id").unionByName(
        decisions.select("bucket").distinct().select(F.lit(None).cast("bigint").alias("doc_id"), "bucket"), allowMissingColumns=True
    )
    marks = marks.withColumn("bucket", F.coalesce("bucket", _bucket(F.lit(buckets))))
    rows = (
        chunks.withColumn("bucket", _bucket(F.lit(buckets)))
        .unionByName(marks, allowMissingColumns=True)
        .join(fresh, "doc_id", "left")
        .withColumns({"run": F.lit(run).cast("bigint"), "buckets": F.lit(buckets).cast("int")})
    )
    if begun:
        touched = decisions.select("bucket").distinct()  # at most one row for each bucket
        kept = stored.join(F.broadcast(touched), "bucket", "left_semi").where("doc_id is not null")
        rows = kept.join(decisions.select("doc_id"), "doc_id", "left_anti").unionByName(rows, allowMissingColumns=True)
        # Written apart first: the commit then only moves rows, and a lost task cannot read what it replaces.
        rows = written(rows.select(*stored.columns), "replaced")
    mode = "dynamic" if begun else "static"
    rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(folder)
    return decisions.select("doc_id", "change")
