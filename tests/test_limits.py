"""Sessions that timers close, against the batch form, over restarts and with late rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casebook.operators.sessions import close_sessions
from casebook.streaming import limits

ACTIONS = "session_id bigint, ts timestamp, offset_s bigint, kind string"
SETTINGS = "session_id bigint, time_limit_min bigint, pause_enabled boolean"
KINDS = ["user_message", "pause", "pause", "evidence", "end", "user_message", "opponent_message"]


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(limits.STORE, limits.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset(limits.STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def action(session, second, kind):
    return (session, dt.datetime(1970, 1, 1) + dt.timedelta(seconds=second), second, kind)


def run(spark, source, settings, tmp_path):
    stream = spark.readStream.schema(ACTIONS).option("maxFilesPerTrigger", 1).parquet(source)
    limits.start_limits(stream, settings, str(tmp_path / "out"), str(tmp_path / "state"), "10 seconds").awaitTermination()
    return sorted(map(tuple, limits.read_closed(spark, str(tmp_path / "out")).collect()))


def test_restart_equals_batch(spark, rocksdb, tmp_path):
    """Actions come in order, a file a run; each run goes on from the state of the one before."""
    rng = random.Random(4)
    rows = []
    for session in range(8):
        start = rng.randrange(1, 300)
        rows += [action(session, start + rng.randrange(140), rng.choice(KINDS)) for _ in range(rng.randrange(1, 14))]
        rows += [action(session, start, "user_message")] * 2
    rows.sort(key=lambda r: r[2])
    settings = spark.createDataFrame([(s, s % 3, s % 2 == 0) for s in range(8)], SETTINGS)
    source = str(tmp_path / "in")
    third = len(rows) // 3
    sizes = []
    for part in (rows[:third], rows[third : 2 * third], rows[2 * third :], [action(-1, 10_000, "tick")]):
        spark.createDataFrame(part, ACTIONS).coalesce(1).write.mode("append").parquet(source)
        got = run(spark, source, settings, tmp_path)
        sizes.append(len(got))
    batch = close_sessions(spark.createDataFrame(rows, ACTIONS).drop("ts"), settings)
    assert got == sorted(map(tuple, batch.select(*(c.split()[0] for c in limits.CLOSED.split(", "))).collect()))
    assert len(got) == 8 and sizes[0] < 8


def test_a_late_row_changes_nothing(spark, rocksdb, tmp_path):
    settings = spark.createDataFrame([(1, 1, False), (2, 1, False)], SETTINGS)
    source = str(tmp_path / "in")
    for part in ([action(1, 100, "user_message")], [action(2, 600, "user_message")], [action(1, 105, "end")], [action(-1, 9_000, "tick")]):
        spark.createDataFrame(part, ACTIONS).coalesce(1).write.mode("append").parquet(source)
        got = run(spark, source, settings, tmp_path)
    assert got == [(1, 160, "time_up", 1, 2, 0), (2, 660, "time_up", 1, 2, 0)]


def test_needs_its_state_store(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([], ACTIONS).write.parquet(source)
    with pytest.raises(ValueError, match="RocksDB"):
        limits.start_limits(
            spark.readStream.schema(ACTIONS).parquet(source), spark.createDataFrame([], SETTINGS), "o", "c", "1 second"
        )


def test_deadlines():
    assert limits.accepted([1, 5, 11, 12, 30, 50], True) == [1, 11, 30] and limits.accepted([1], False) == []
    assert limits.deadline(0, 60, [59, 69, 80]) == 80 and limits.deadline(0, 60, [60]) == 60


def test_neighbouring_sessions_share_a_value(spark, rocksdb, tmp_path):
    """Seconds, settings and timers of 1,280 sessions are a few values of the state store, not some of each."""
    first = -limits.SESSIONS
    rows = [action(s, 1000 + t, "user_message") for s in range(first, first + 1280) for t in range(5)]
    settings = spark.createDataFrame([(s, 1, False) for s in range(first, first + 1280)], SETTINGS)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, ACTIONS).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(ACTIONS).parquet(source)
    query = limits.start_limits(stream, settings, target, str(tmp_path / "state"), "10 seconds")
    query.awaitTermination()
    kept = max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"])
    assert 0 < kept <= 4 * 1280 // limits.SESSIONS
    spark.createDataFrame([action(-10_000, 9_000, "tick")], ACTIONS).write.mode("append").parquet(source)
    assert run(spark, source, settings, tmp_path) == [(s, 1060, "time_up", 5, 4, 0) for s in range(first, first + 1280)]


def test_sessions_of_a_block_close_one_by_one(spark, rocksdb, tmp_path):
    """Against the batch form: sessions of a few blocks, in many runs, each with rows of sessions that are closed already."""
    rng = random.Random(9)
    ids = [*range(-70, -50), *range(50, 70), 2**40, 2**40 + 1]
    start = {s: rng.randrange(1, 900) for s in ids}
    rows = [action(s, start[s] + rng.randrange(150), rng.choice(KINDS)) for s in ids for _ in range(rng.randrange(1, 9))]
    rows = sorted([*rows, *(action(s, start[s], "pause") for s in ids)], key=lambda r: r[2])
    # Nothing comes after an end: the batch form counts pauses there, a closed session does not.
    ends = {r[0]: r[2] for r in reversed(rows) if r[3] == "end"}
    rows = [r for r in rows if r[2] <= ends.get(r[0], r[2])]
    settings = spark.createDataFrame([(s, abs(s) % 3, s % 2 == 0) for s in ids], SETTINGS)
    source, cut, sizes = str(tmp_path / "in"), len(rows) // 4 + 1, []
    for part in (*(rows[at : at + cut] for at in range(0, len(rows), cut)), [action(-1000, 9_000, "tick")], [action(s, 9_050, "end") for s in ids]):
        spark.createDataFrame(part, ACTIONS).coalesce(1).write.mode("append").parquet(source)
        got = run(spark, source, settings, tmp_path)
        sizes.append(len(got))
    batch = close_sessions(spark.createDataFrame(rows, ACTIONS).drop("ts"), settings)
    assert got == sorted(map(tuple, batch.select(*(c.split()[0] for c in limits.CLOSED.split(", "))).collect()))
    assert 0 < sizes[1] < sizes[3] < sizes[4] == len(ids)
