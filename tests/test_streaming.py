import datetime as dt
import random

from casebook.operators.badges import tally
from casebook.operators.messages import upsert
from casebook.plans import streams
from casebook.streaming import badges, messages, sessions, updates
from casebook.streaming.table import KeyedTable

EARNED = "user_id int, badge_id string, ts timestamp"


def in_files(spark, df, folder, files=4):
    df.repartition(files).write.parquet(folder)


def one_file_at_a_time(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_tally_over_many_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randint(1, 5), rng.choice("abc"), dt.datetime(2024, 1, rng.randint(1, 28))) for _ in range(200)]
    df = spark.createDataFrame(rows, EARNED)
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    in_files(spark, df, source)
    query = badges.start_tally(one_file_at_a_time(spark, EARNED, source), target, state)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4
    assert sorted(badges.read_tally(spark, target, "timestamp").collect()) == sorted(tally(df).collect())

    df.limit(50).write.mode("append").parquet(source)
    again = badges.start_tally(one_file_at_a_time(spark, EARNED, source), target, state)
    again.awaitTermination()
    whole = sorted(tally(spark.read.parquet(source)).collect())
    assert sorted(badges.read_tally(spark, target, "timestamp").collect()) == whole

    idle = badges.start_tally(one_file_at_a_time(spark, EARNED, source), target, state)
    idle.awaitTermination()
    assert sorted(badges.read_tally(spark, target, "timestamp").collect()) == whole


def gaps(rows, gap):
    """All sessions of (user, time) rows: (user, first, last + gap, events)."""
    want = set()
    for user in {u for u, _ in rows}:
        times, group = sorted(t for u, t in rows if u == user), []
        for t in [*times, None]:
            if group and (t is None or t >= group[-1] + gap):
                want.add((user, group[0], group[-1] + gap, len(group)))
                group = []
            group.append(t)
    return want


def test_sessions_in_any_order_of_arrival(spark, tmp_path):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.randint(1, 3), start + dt.timedelta(minutes=rng.randint(0, 3000))) for _ in range(120)]
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for file in range(6):  # late events join sessions of earlier files
        spark.createDataFrame(rows[file::6], "user_id int, ts timestamp").coalesce(1).write.mode("append").parquet(source)
    stream = one_file_at_a_time(spark, "user_id int, ts timestamp", source)
    query = sessions.start_sessions(stream, "30 minutes", target, state)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 6
    table = sessions.read_sessions(spark, target, "30 minutes", "10 minutes").collect()
    gap, mark = dt.timedelta(minutes=30), max(t for _, t in rows) - dt.timedelta(minutes=10)
    assert {(r.user_id, r.started, r.ended, r.events) for r in table} == gaps(rows, gap)
    assert len(table) == len(gaps(rows, gap))
    assert all(r.closed == (r.ended <= mark) for r in table) and not all(r.closed for r in table)


def test_a_late_event_joins_two_sessions(spark, tmp_path):
    at = lambda minute: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batches = [[(1, at(0)), (1, at(50)), (2, at(5))], [(1, at(100))], [(1, at(25))], [(1, at(75)), (1, at(-20))]]
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, "user_id int, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = one_file_at_a_time(spark, "user_id int, ts timestamp", source)
        sessions.start_sessions(stream, "30 minutes", target, state).awaitTermination()
        seen = [r for b in batches[: n + 1] for r in b]
        table = sessions.read_sessions(spark, target, "30 minutes", "0 minutes").collect()
        assert sorted((r.user_id, r.started, r.ended, r.events) for r in table) == sorted(gaps(seen, dt.timedelta(minutes=30)))


def test_repeated_ids_are_dropped_in_any_order_of_arrival(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    # The oldest message comes last.
    rows = [(9 - i // 4, day - dt.timedelta(days=i)) for i in range(40)]
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "msg_id int, ts timestamp"
    for file in range(5):
        part = [(i, d) for i, d in rows if i % 5 == file or i == 3]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = one_file_at_a_time(spark, schema, source)
    messages.start_deduplicated(stream, ["msg_id"], target, state).awaitTermination()
    got = messages.read_deduplicated(spark, target, ["msg_id"], schema).collect()
    assert sorted(r.msg_id for r in got) == list(range(10))


def test_a_batch_writes_only_what_it_touches_and_can_run_again(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], "k bigint, v string")
    rows = lambda *r: spark.createDataFrame(r, "k bigint, v string")
    assert table.read().count() == 0
    table.write(rows(*[(i, "a") for i in range(500)]), 0)
    table.write(rows((7, "b")), 1)
    assert spark.read.parquet(f"{table.folder}/batch=1").count() == 1
    assert table.read(before=1).where("k = 7").first().v == "a"
    table.write(rows((7, "c")), 1)  # the same batch again
    assert table.read().where("k = 7").first().v == "c" and table.read().count() == 500
    table.write(rows((7, "c")).selectExpr("k", "v", "true gone"), 2)
    assert table.read().count() == 499
    plan = table.read(like=rows((7, "x")))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan


def test_upsert_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    schema = "conv_id bigint, msg_id string, seq bigint, role string, text string"
    rows = [(rng.randint(1, 3), f"m{rng.randint(1, 9)}", i, "user", f"t{i}") for i in range(80)]
    df = spark.createDataFrame(rows, schema)
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    in_files(spark, df, source)
    query = messages.start_upsert(one_file_at_a_time(spark, schema, source), target, state)
    query.awaitTermination()
    streamed = messages.read_upserted(spark, target)
    batch = upsert(df.filter("false"), df).select(*streamed.columns)
    assert sorted(streamed.collect()) == sorted(batch.collect())


def test_updates_over_batches_restarts_and_snapshots(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.randint(1, 30), rng.choice("abc"), dt.datetime(2024, 1, rng.randint(1, 28))) for _ in range(400)]
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    read = lambda: sorted(tuple(r) for r in updates.read_updates(spark, target, "timestamp").collect())
    want = lambda n: sorted(tuple(r) for r in tally(spark.createDataFrame(rows[:n], EARNED)).collect())

    def arrive(first, last):
        spark.createDataFrame(rows[first:last], EARNED).coalesce(1).write.mode("append").parquet(source)
        with updates.rocksdb(spark):
            query = updates.start_updates(one_file_at_a_time(spark, EARNED, source), target, state)
            query.awaitTermination()
        return query

    assert read() == []
    done = 0
    for size in (200, 100, 1, 50):
        arrive(done, done + size)
        done += size
        assert read() == want(done)
    # The batch of one event wrote one key.
    assert 1 in [spark.read.parquet(str(p)).count() for p in (tmp_path / "out" / "changes").iterdir()]
    assert updates.compact(spark, target, "timestamp") > 0 and read() == want(done)
    assert updates.compact(spark, target, "timestamp") == 0
    arrive(done, 400)
    assert read() == want(400)
    updates.compact(spark, target, "timestamp")
    assert read() == want(400) and len(list((tmp_path / "out" / "snapshots").iterdir())) == 1
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != updates.ROCKSDB


def test_a_streamed_table_may_be_a_file_or_a_folder_of_files(spark, tmp_path):
    rows = [(1, turn, "user", f"t{turn}") for turn in range(40)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    whole, parts = tmp_path / "whole", tmp_path / "parts"
    in_files(spark, table, str(parts / "conversations.parquet"))
    whole.mkdir()
    table.toPandas().to_parquet(whole / "conversations.parquet")
    want = sorted((1, f"1-{turn}", turn, "user", f"revised: t{turn}") for turn in range(40))
    for folder in (whole, parts):
        assert sorted(map(tuple, streams.stream_log_upsert(spark, str(folder)).collect())) == want
