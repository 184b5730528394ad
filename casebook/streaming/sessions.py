"""Sessions by inactivity, kept as a table that late events still change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casebook.streaming.table import BUCKETS, KeyedTable

KEYS = ["user_id", "started"]


def _table(spark: SparkSession, folder: str) -> KeyedTable:
    # A user's sessions share a bucket, as the bucket is of the user alone.
    return _ByUser(spark, folder, KEYS, "user_id bigint, started timestamp, last timestamp, events bigint")


class _ByUser(KeyedTable):
    def _bucket(self):
        return F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int")


def joined_sessions(spans: DataFrame, gap: str) -> DataFrame:
    """Spans (user_id, started, last, events, ...) of a user that lie less than ``gap`` apart, numbered as one session.

    Adds ``session``: the start of the session that the span belongs to.
    """
    before = Window.partitionBy("user_id").orderBy("started", "last").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("user_id").orderBy("started", "last").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.col("last")).over(before) + F.expr(f"interval {gap}")
    opens = F.when(reach.isNull() | (F.col("started") >= reach), F.col("started"))
    return spans.withColumn("opens", opens).withColumn("session", F.last("opens", ignorenulls=True).over(upto)).drop("opens")


def start_sessions(events: DataFrame, gap: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the table of all sessions of a stream ``events(user_id, ts)``, open ones too.

    A session ends ``gap`` after its last event. Events may come in any order: each
    batch first joins its own events to spans, then the spans with the stored sessions
    of these users. A late event can lengthen a session or join two; the session that
    is then no more is marked as gone.
    """
    # Events of a span meet in their task before they are shuffled.
    events.sparkSession.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")

    def merge(batch: DataFrame, number: int) -> None:
        table = _table(batch.sparkSession, folder)
        window = F.session_window("ts", gap)
        new = (
            batch.groupBy("user_id", window.alias("w"))
            .agg(F.count("*").alias("events"), F.min("ts").alias("started"), F.max("ts").alias("last"))
            .select("user_id", "started", "last", "events", F.lit(True).alias("new"))
        )
        # Only sessions within reach of the user's new spans can change.
        reach = new.groupBy("user_id").agg(
            (F.min("started") - F.expr(f"interval {gap}")).alias("lo"), (F.max("last") + F.expr(f"interval {gap}")).alias("hi")
        )
        stored = (
            table.read(number, new.select("user_id"))
            .join(reach, "user_id")
            .where("last >= lo and started <= hi")
            .select("user_id", "started", "last", "events", F.lit(False).alias("new"))
        )
        groups = joined_sessions(new.unionByName(stored), gap)
        merged = (
            groups.groupBy("user_id", "session")
            .agg(
                F.max("last").alias("last"),
                F.sum("events").alias("events"),
                F.max("new").alias("touched"),
                F.collect_set(F.when(~F.col("new"), F.col("started"))).alias("were"),
            )
            .where("touched")
        )
        gone = merged.select("user_id", "session", F.explode("were").alias("started")).where("started <> session")
        # An absorbed start that is also the start of a merged session is no tombstone; starts of a user are distinct.
        changed = merged.select("user_id", F.col("session").alias("started"), "last", "events", F.lit(False).alias("gone"))
        removed = gone.select("user_id", "started", F.lit(None).cast("timestamp").alias("last"), F.lit(0).cast("long").alias("events"), F.lit(True).alias("gone"))
        table.write(changed.unionByName(removed), number)

    return (
        events.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_sessions(spark: SparkSession, folder: str, gap: str, delay: str) -> DataFrame:
    """(user_id, started, ended, events, closed): ``closed`` once the latest event of all is ``delay`` past the end."""
    rows = _table(spark, folder).read()
    ended = F.col("last") + F.expr(f"interval {gap}")
    mark = rows.agg((F.max("last") - F.expr(f"interval {delay}")).alias("mark")).scalar()
    return rows.select("user_id", "started", ended.alias("ended"), "events", (ended <= mark).alias("closed"))
