"""Badge tally as a running aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from casebook.operators.badges import merge_tallies, tally
from casebook.streaming.table import KeyedTable

KEYS = ["user_id", "badge_id"]


def _table(spark: SparkSession, folder: str, time_type: str = "timestamp_ntz") -> KeyedTable:
    return KeyedTable(spark, folder, KEYS, f"user_id bigint, badge_id string, cnt bigint, last_earned {time_type}")


def read_tally(spark: SparkSession, folder: str, time_type: str = "timestamp_ntz") -> DataFrame:
    return _table(spark, folder, time_type).read()


def start_tally(earned: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep a tally table of a stream of earned badges (user_id, badge_id, ts).

    Each micro-batch is tallied on its own, merged with the stored rows of the same
    keys, and written for these keys alone.
    """
    time_type = dict(earned.dtypes)["ts"]

    def merge(batch: DataFrame, number: int) -> None:
        table = _table(batch.sparkSession, folder, time_type)
        change = tally(batch)
        stored = table.read(number, change).join(change.select(*KEYS), KEYS, "left_semi")
        table.write(merge_tallies(stored, change), number)

    return (
        earned.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
