"""Registered queries: the streaming jobs, run over all available input.

Each run writes its result to a new folder below the shared folder and returns
that table. Stream input has no time zone, so event times of sessions are cast to
timestamp and back for the result.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from casebook.plans import inputs
from casebook.plans import sessions as sessions_plan
from casebook.plans import sql as S
from casebook.schemas import EVENT, MESSAGE
from casebook.session import fresh_path
from casebook.streaming import badges, limits, messages, sessions, updates

GAP, DELAY = "6 hours", "1 hour"


def _stream(spark, folder, name, schema):
    """The stream of a table that is one file, or a folder of files."""
    reader = spark.readStream.schema(schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}.parquet")
    # A stream reads folders only.
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def stream_badge_tally(spark, folder):
    target, checkpoint = fresh_path(spark, "tally"), fresh_path(spark, "tally-state")
    earned = inputs.earned_badges(_stream(spark, folder, "events", EVENT))
    badges.start_tally(earned, target, checkpoint).awaitTermination()
    return badges.read_tally(spark, target)


def stream_badge_update(spark, folder):
    target, checkpoint = fresh_path(spark, "updates"), fresh_path(spark, "updates-state")
    earned = inputs.earned_badges(_stream(spark, folder, "events", EVENT))
    with updates.rocksdb(spark):
        updates.start_updates(earned, target, checkpoint).awaitTermination()
    return updates.read_updates(spark, target)


def stream_sessions(spark, folder):
    target, checkpoint = fresh_path(spark, "sessions"), fresh_path(spark, "sessions-state")
    events = _stream(spark, folder, "events", EVENT).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    sessions.start_sessions(events, GAP, target, checkpoint).awaitTermination()
    rows = sessions.read_sessions(spark, target, GAP, DELAY)
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


def stream_log(spark, folder):
    """One message per user, type and day."""
    target, checkpoint = fresh_path(spark, "log"), fresh_path(spark, "log-state")
    keys = ["user_id", "event_type", "day"]
    events = _stream(spark, folder, "events", EVENT).select(
        "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")
    )
    messages.start_deduplicated(events, keys, target, checkpoint).awaitTermination()
    schema = "user_id bigint, event_type string, day string"
    return messages.read_deduplicated(spark, target, keys, schema)


def stream_log_upsert(spark, folder):
    """Every message arrives twice: as written, and revised under the same id."""
    target, checkpoint = fresh_path(spark, "upsert"), fresh_path(spark, "upsert-state")
    log = _stream(spark, folder, "conversations", MESSAGE)
    versions = F.array(
        F.struct(F.col("turn").alias("seq"), F.col("text").alias("text")),
        F.struct((F.col("turn") + 1000).alias("seq"), F.concat(F.lit("revised: "), "text").alias("text")),
    )
    arriving = log.select(
        "conv_id", F.concat_ws("-", "conv_id", "turn").alias("msg_id"), "role", F.inline(versions)
    )
    messages.start_upsert(arriving, target, checkpoint).awaitTermination()
    return messages.read_upserted(spark, target)


WEEK = 7 * 86400


def stream_session_limit(spark, folder):
    """Sessions closed by timers. A week's session lies in its own 700 seconds of stream time; a last tick ends the stream."""
    target, checkpoint, ticks = (fresh_path(spark, name) for name in ("limits", "limits-state", "ticks"))
    schema = "session_id bigint, ts timestamp, offset_s bigint, kind string"
    spark.createDataFrame([(-1, dt.datetime(2000, 1, 1), 0, "tick")], schema).write.parquet(ticks)
    events = _stream(spark, folder, "events", EVENT)
    start = (F.col("session_id") % 10 + 1) * WEEK
    offset = start + F.col("offset_s")
    actions = inputs.session_log_of(events).select("session_id", F.timestamp_seconds(offset).alias("ts"), offset.alias("offset_s"), "kind")
    actions = actions.unionByName(spark.readStream.schema(schema).parquet(ticks))
    before = spark.conf.get(limits.STORE, None)
    spark.conf.set(limits.STORE, limits.ROCKSDB)
    try:
        limits.start_limits(actions, inputs.session_settings(spark, folder), target, checkpoint, "1 hour").awaitTermination()
    finally:
        spark.conf.unset(limits.STORE) if before is None else spark.conf.set(limits.STORE, before)
    return limits.read_closed(spark, target).withColumn("closed_s", F.col("closed_s") - start)


QUERIES = {
    "stream_session_limit": (stream_session_limit, sessions_plan.QUERIES["session_close"][1]),
    "stream_badge_update": (stream_badge_update, f"WITH {S.TALLY} SELECT * FROM tally"),
    "stream_badge_tally": (stream_badge_tally, f"WITH {S.TALLY} SELECT * FROM tally"),
    "stream_sessions": (
        stream_sessions,
        """WITH gaps AS (
             SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens
             FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
           runs AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, opens DESC
                      ROWS UNBOUNDED PRECEDING) AS run FROM gaps)
           SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS events,
             max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AS closed
           FROM runs GROUP BY user_id, run""",
    ),
    "stream_log": (
        stream_log,
        "SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events",
    ),
    "stream_log_upsert": (
        stream_log_upsert,
        """SELECT conv_id, conv_id || '-' || turn AS msg_id, turn AS position, role,
                  'revised: ' || text AS text FROM conversations""",
    ),
}
