"""Message log as a stream: repeated ids dropped, replacements merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casebook.streaming.table import KeyedTable


def start_deduplicated(messages: DataFrame, keys: list[str], folder: str, checkpoint: str) -> StreamingQuery:
    """Keep each id once, in whatever order messages arrive: what is stored decides, not a watermark.

    Of messages with the same id in one batch any one is kept.
    """
    schema = ", ".join(f"{name} {kind}" for name, kind in messages.dtypes)

    def merge(batch: DataFrame, number: int) -> None:
        table = KeyedTable(batch.sparkSession, folder, keys, schema)
        first = batch.dropDuplicates(keys)
        table.write(first.join(table.read(number, first).select(*keys), keys, "left_anti"), number)

    return (
        messages.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_deduplicated(spark: SparkSession, folder: str, keys: list[str], schema: str) -> DataFrame:
    return KeyedTable(spark, folder, keys, schema).read()


def _log(spark: SparkSession, folder: str) -> KeyedTable:
    schema = "conv_id bigint, msg_id string, position bigint, role string, text string, seq bigint"
    return KeyedTable(spark, folder, ["conv_id", "msg_id"], schema)


def _latest(rows: DataFrame) -> DataFrame:
    kept = F.max_by(F.struct("role", "text", "seq"), "seq")
    return (
        rows.groupBy("conv_id", "msg_id")
        .agg(F.min("position").alias("position"), kept.alias("_k"))
        .select("conv_id", "msg_id", "position", "_k.role", "_k.text", "_k.seq")
    )


def start_upsert(messages: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of the latest content per message id at its first position.

    ``messages(conv_id, msg_id, seq, role, text)``. Every batch writes the messages it
    touches, merged with what is stored of them.
    """

    def merge(batch: DataFrame, number: int) -> None:
        table = _log(batch.sparkSession, folder)
        rows = _latest(batch.withColumn("position", F.col("seq")))
        stored = table.read(number, rows).join(rows.select("conv_id", "msg_id"), ["conv_id", "msg_id"], "left_semi")
        table.write(_latest(stored.unionByName(rows)), number)

    return (
        messages.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_upserted(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).read().drop("seq")
