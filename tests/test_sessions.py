import random

import pytest
from pyspark.sql import functions as F

from casebook.functions.labels import date_label, stars, timer_class, timer_text
from casebook.operators import sessions as S
from casebook.operators.strategy import dangling_links, linked_evidence, live_arguments

ACTION = "session_id bigint, event_id bigint, offset_s bigint, kind string"
SETTING = "session_id bigint, time_limit_min int, objection_limit int, pause_enabled boolean"


def actions(spark, rows):
    return spark.createDataFrame([(s, i, t, k) for i, (s, t, k) in enumerate(rows)], ACTION).repartition(4)


def settings(spark, *rows):
    return spark.createDataFrame(list(rows), SETTING)


def test_rounds(spark):
    log = actions(
        spark,
        [(1, 0, "opponent_message")]
        + [(1, 10 * n + j, k) for n in range(1, 7) for j, k in enumerate(["user_message", "opponent_message"])],
    )
    got = S.round_numbers(log).orderBy("offset_s").collect()
    assert [r.round for r in got if r.kind == "user_message"] == [1, 2, 3, 4, 4, 4]
    assert [r.round for r in got if r.kind == "opponent_message"] == [None, 1, 2, 3, 4, 4, 4]


def test_objections(spark):
    log = actions(spark, [(s, t, "objection") for s in (1, 2) for t in range(4)] + [(3, 0, "pause")])
    limits = settings(spark, (1, 10, 0, True), (2, 10, 2, True), (3, 10, 5, True))
    kept = S.kept_objections(log, limits)
    assert sorted((r.session_id, r.n, r.remaining) for r in kept.collect()) == [
        (1, 1, 2), (1, 2, 1), (1, 3, 0), (2, 1, 1), (2, 2, 0),
    ]
    wide = S.kept_objections(log, settings(spark, (1, 10, 2000, True), (2, 10, 2, True)))
    assert sorted((r.session_id, r.n) for r in wide.collect()) == [(1, n) for n in (1, 2, 3, 4)] + [(2, 1), (2, 2)]
    balance = {r.session_id: (r.pressed, r.kept, r.remaining) for r in S.objection_balance(log, limits).collect()}
    assert balance == {1: (4, 3, 0), 2: (4, 2, 0), 3: (0, 0, 5)}


def sequential_pauses(times):
    out = []
    for t in sorted(times):
        if len(out) < 3 and (not out or t >= out[-1] + 10):
            out.append(t)
    return out


def test_pauses_follow_the_sequential_rule(spark):
    rng = random.Random(1)
    presses = {s: [rng.randint(0, 80) for _ in range(rng.randint(0, 12))] for s in range(40)}
    log = actions(spark, [(s, t, "pause") for s, ts in presses.items() for t in ts])
    limits = settings(spark, *[(s, 10, 3, s % 5 != 0) for s in presses])
    got = {}
    for r in S.pause_rows(S.accepted_pauses(log, limits)).orderBy("session_id", "n").collect():
        got.setdefault(r.session_id, []).append(r.offset_s)
    assert got == {s: sequential_pauses(t) for s, t in presses.items() if t and s % 5}


def test_time_remaining_and_default_limit(spark):
    log = actions(spark, [(1, 100, "pause"), (1, 220, "user_message"), (2, 0, "pause"), (2, 900, "evidence")])
    limits = settings(spark, (1, 0, 3, True), (2, 5, 3, False))
    got = {r.session_id: (r.pauses, r.time_remaining) for r in S.time_remaining(log, limits).collect()}
    assert got == {1: (1, 600 - 120 + 10), 2: (0, 0)}


def test_close(spark):
    log = actions(
        spark,
        [(1, 0, "user_message"), (1, 50, "end"), (1, 60, "user_message")]
        + [(2, 0, "pause"), (2, 305, "user_message"), (2, 311, "user_message"), (2, 400, "end")]
        + [(3, 5, "evidence")],
    )
    limits = settings(spark, (1, 5, 3, True), (2, 5, 3, True), (3, 5, 3, True))
    columns = ["closed_s", "reason", "actions_kept", "rounds_completed", "time_remaining"]
    closed = S.close_sessions(log, limits).select("session_id", *columns)
    got = {r.session_id: tuple(r)[1:] for r in closed.collect()}
    assert got == {
        1: (50, "ended", 2, 2, 250),
        2: (310, "time_up", 2, 2, 0),
        3: (305, "time_up", 1, 1, 0),
    }


@pytest.mark.parametrize(
    "seconds,name", [(0, "critical"), (60, "critical"), (61, "warning"), (180, "warning"), (181, "")]
)
def test_timer_class(one, seconds, name):
    assert one(timer_class(F.lit(seconds))) == name


def test_labels(one):
    assert one(timer_text(F.lit(65))) == "01:05"
    assert one(timer_text(F.lit(65), pad_minutes=False)) == "1:05"
    assert one(timer_text(F.lit(6001))) == "100:01"
    assert one(date_label(F.lit(None).cast("timestamp"))) == ""
    assert one(stars(F.lit(3))) == "⭐⭐⭐"


def test_lines_and_lookup(spark):
    df = spark.createDataFrame([(1, "a\n\nb"), (2, "")], "id int, text string")
    assert sorted(tuple(r) for r in S.split_lines(df, ["id"]).collect()) == [
        (1, 1, "a"), (1, 2, ""), (1, 3, "b"), (2, 1, ""),
    ]
    keys = spark.createDataFrame([("1",), ("9",), ("abc",), (" 1x",)], "key string")
    scenarios = spark.createDataFrame([(1, "x")], "id int, name string")
    got = {r.key: (r.found, r.name) for r in S.lookup_scenarios(keys, scenarios, "key").collect()}
    assert got == {"1": (True, "x"), "9": (False, None), "abc": (False, None), " 1x": (True, "x")}


def test_merge_documents(spark):
    rows = [
        (1, 1, {"role": "a", "coach": "c"}),
        (1, 2, {"role": "b"}),
        (1, 3, {"coach": None}),
    ]
    df = spark.createDataFrame(rows, "sid int, seq int, patch map<string,string>").repartition(3)
    got = S.merge_documents(df, "sid", ["seq"], "patch", ["role", "coach", "strategy"]).first()
    assert tuple(got) == (1, "b", None, None)


EDIT = "session_id bigint, offset_s bigint, event_id bigint, op string, arg_id bigint, text string"


def sequential_edits(edits):
    live = [(1, "")]
    for op, arg, text in edits:
        if op == "add":
            live.append((arg, ""))
        elif op == "replace":
            live = [(a, text if a == arg else t) for a, t in live]
        elif len(live) > 1:
            live = [x for x in live if x[0] != arg]
    return live


@pytest.mark.parametrize("ids", [2, 4, 30])
def test_argument_edits_follow_the_sequential_rule(spark, ids):
    rng = random.Random(ids)
    log = {
        s: [
            (rng.choice(["add", "replace", "remove", "remove"]), rng.randint(1, ids), f"t{n}")
            for n in range(rng.randint(0, 25))
        ]
        for s in range(60)
    }
    rows = [(s, n // 2, n, *e) for s, edits in log.items() for n, e in enumerate(edits)]
    sessions = spark.createDataFrame([(s,) for s in log], "session_id bigint")
    got = {s: [] for s in log}
    result = live_arguments(spark.createDataFrame(rows, EDIT).repartition(4), sessions)
    for r in result.orderBy("session_id", "added_s", "added_by").collect():
        got[r.session_id].append((r.arg_id, r.text))
    assert got == {s: sequential_edits(e) for s, e in log.items()}


def test_argument_edits_when_joins_become_broadcasts_at_run_time(spark):
    rng = random.Random(5)
    log = {
        s: [(rng.choice(["add", "replace", "remove", "remove"]), rng.randint(1, 3), f"t{n}") for n in range(12)]
        for s in range(2000)
    }
    rows = [(s, n, n, *e) for s, edits in log.items() for n, e in enumerate(edits)]
    sessions = spark.createDataFrame([(s,) for s in log], "session_id bigint")
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(static)
    spark.conf.set(static, "-1")
    spark.conf.set(adaptive, "10m")
    try:
        result = live_arguments(spark.createDataFrame(rows, EDIT).repartition(4), sessions).collect()
    finally:
        spark.conf.set(static, before)
        spark.conf.unset(adaptive)
    got = {s: [] for s in log}
    for r in sorted(result, key=lambda r: (r.session_id, r.added_s, r.added_by)):
        got[r.session_id].append((r.arg_id, r.text))
    assert got == {s: sequential_edits(e) for s, e in log.items()}


def test_links(spark):
    toggles = [(1, "e", 1)] + [(1, "e", 2)] * 2 + [(1, "e", 3)] * 3
    links = linked_evidence(spark.createDataFrame(toggles, "session_id bigint, evidence_id string, argument_id bigint"))
    assert sorted(r.argument_id for r in links.collect()) == [1, 3]
    live = spark.createDataFrame([(1, 3), (1, 3)], "session_id bigint, arg_id bigint")
    assert [r.argument_id for r in dangling_links(links, live).collect()] == [1]
