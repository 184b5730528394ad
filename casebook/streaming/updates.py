"""Badge tally kept in the state store: a batch reads nothing and writes only the keys it changed.

The running aggregate lives in Spark's state store on RocksDB, which holds what does
not fit in memory on disk and uploads changes only. Each micro-batch hands over the
new totals of its keys (update mode), written to a folder of its own; of a key the
latest batch holds. `compact` folds old batches into one snapshot.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casebook.operators.badges import tally
from casebook.streaming.limits import ROCKSDB, STORE

KEYS = ["user_id", "badge_id"]


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own setting comes back."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def start_updates(earned: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Tally a stream of earned badges (user_id, badge_id, ts); start it inside `rocksdb`."""

    def put(batch: DataFrame, number: int) -> None:
        # The folder is the batch's own, so a batch that runs again writes the same.
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    return (
        tally(earned)
        .writeStream.outputMode("update")
        .foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _batches(spark: SparkSession, folder: str) -> dict[int, object]:
    """Finished batch folders by number; those of a broken write have no success mark."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path(folder)):
        return {}
    found = {int(s.getPath().getName().split("=")[1]): s.getPath() for s in files.listStatus(path(folder)) if "=" in s.getPath().getName()}
    return {n: p for n, p in found.items() if files.exists(path(p, "_SUCCESS"))}


def read_updates(spark: SparkSession, folder: str, time_type: str = "timestamp_ntz") -> DataFrame:
    """The latest totals of every key: the last snapshot and the changes after it."""
    schema = f"user_id bigint, badge_id string, cnt bigint, last_earned {time_type}"
    snapshots, changes = _batches(spark, f"{folder}/snapshots"), _batches(spark, f"{folder}/changes")
    last = max(snapshots, default=-1)
    parts = [(n, p) for n, p in changes.items() if n > last] + ([(last, snapshots[last])] if snapshots else [])
    if not parts:
        return spark.createDataFrame([], schema)
    rows = None
    for kind in ("changes", "snapshots"):
        paths = [p.toString() for _, p in parts if p.getParent().getName() == kind]
        if paths:
            read = spark.read.option("basePath", f"{folder}/{kind}").schema(f"{schema}, batch bigint").parquet(*paths)
            rows = read if rows is None else rows.unionByName(read)
    latest = rows.groupBy(*KEYS).agg(F.max_by(F.struct("cnt", "last_earned"), "batch").alias("last"))
    return latest.select(*KEYS, "last.cnt", "last.last_earned")


def compact(spark: SparkSession, folder: str, time_type: str = "timestamp_ntz") -> int:
    """Fold all changes so far into one snapshot and delete what it replaces; how many folders went.

    Readers that opened the table before read the deleted files, so run it when none does.
    """
    changes, old = _batches(spark, f"{folder}/changes"), _batches(spark, f"{folder}/snapshots")
    if not changes or max(changes) <= max(old, default=-1):
        return 0
    read_updates(spark, folder, time_type).write.mode("overwrite").parquet(f"{folder}/snapshots/batch={max(changes)}")
    gone = [*changes.values(), *(p for n, p in old.items() if n != max(changes))]
    for path in gone:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)
