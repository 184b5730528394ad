import random

import pytest
from pyspark.sql import functions as F

from casebook import fixed_values as V
from casebook.functions.labels import grade, grade_label
from casebook.operators import badges as B
from casebook.operators.ordering import first_k, numbered, running_totals
from casebook.operators.scoring import earned_badges, session_scores, time_score, with_grade, with_total


@pytest.mark.parametrize(
    "total,mark", [(299, "D"), (300, "C"), (349, "C"), (350, "B"), (399, "B"), (400, "A"), (449, "A"), (450, "S")]
)
def test_grade(one, total, mark):
    assert one(grade(F.lit(total))) == mark
    assert one(grade_label(F.lit(total))) == {g: label for _, g, label in V.GRADES}[mark]


@pytest.mark.parametrize("left,score", [(0, 50), (1, 80), (10, 81), (109, 90), (110, 91), (1200, 200)])
def test_time_score(one, left, score):
    assert one(time_score(F.lit(left))) == score


def test_scores_bonuses_and_total(spark):
    rows = [(60, 70, 65, 80, 0, 2, 1), (60, 70, 65, 80, 110, 3, 2), (60, 70, 65, 80, 5, None, None)]
    names = "legal_base evidence_base persuasion_base etiquette_base time_remaining argument_count evidence_count"
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names.split()))
    got = with_grade(with_total(session_scores(df))).collect()
    assert [(r.evidence_use, r.persuasion, r.time_management, r.total) for r in got] == [
        (70, 65, 50, 325), (85, 75, 91, 391), (70, 65, 80, 355),
    ]
    assert [r.grade for r in got] == ["C", "B", "B"]


def test_badge_edges(spark):
    names = ["total", "evidence_use", "persuasion", "legal_accuracy", "etiquette", "time_management"]
    low, high = (400, 90, 90, 95, 99, 90), (401, 91, 91, 96, 100, 91)
    df = spark.createDataFrame([low, high], ", ".join(f"{n} int" for n in names))
    got = earned_badges(df).orderBy("position").collect()
    assert [r.badge_id for r in got] == ["excellent", "evidence", "persuader", "accurate", "polite", "speed"]


def earned(spark, n, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(1, 4), rng.choice(V.BADGES)[0], rng.randint(0, 10**9)) for _ in range(n)]
    df = spark.createDataFrame(rows, "user_id int, badge_id string, s bigint")
    return df.withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_merged_tallies_equal_tally_of_union(spark):
    a, b = earned(spark, 60, 1), earned(spark, 40, 2)
    merged = B.merge_tallies(B.tally(a), B.tally(b))
    assert sorted(merged.collect()) == sorted(B.tally(a.unionByName(b)).collect())


def test_collection_status_and_totals(spark):
    tally = B.tally(
        spark.createDataFrame([(1, "speed"), (1, "speed"), (1, "polite")], "user_id int, badge_id string").withColumn(
            "ts", F.lit("2024-02-03 04:05:06").cast("timestamp")
        )
    )
    users = spark.createDataFrame([(1,), (2,)], "user_id int")
    status = B.collection_status(users, tally).collect()
    assert len(status) == 24
    assert {(r.user_id, r.badge_id, r.cnt) for r in status if r.unlocked} == {(1, "speed", 2), (1, "polite", 1)}
    assert {r.shown_icon for r in status if not r.unlocked} == {"🔒"}
    total = B.collection_totals(tally).first()
    assert tuple(total) == (1, 2, 3, 17)


SESSION = "user_id int, ts bigint, event_id bigint, role string, won boolean"


def careers(spark):
    rng = random.Random(9)
    rows = [
        (rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 500), i, rng.choice(["defendant", "plaintiff"]), rng.random() < 0.6)
        for i in range(600)
    ]
    return rows, spark.createDataFrame(rows, SESSION).repartition(5)


@pytest.fixture(params=["true", "false"])
def ranges(request, spark):
    """With small ranges joined to one, and with as many ranges as shuffle partitions."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield
    spark.conf.set(key, old)


def test_careers_follow_the_sequential_rule(spark, ranges):
    rows, df = careers(spark)
    badges = {(r.user_id, r.badge_id): r.earned_at for r in B.career_badges(df).collect()}
    summary = {r.user_id: (r.longest, r.streaks) for r in B.streak_summary(B.win_streaks(df)).collect()}
    for user in (1, 2, 3):
        played = sorted((r for r in rows if r[0] == user), key=lambda r: (r[1], r[2]))
        want, run, runs = {"master": played[9][1]}, 0, []
        for _, ts, _, role, won in played:
            if not won:
                run = 0
                continue
            run += 1
            runs = runs + [1] if run == 1 else runs[:-1] + [run]
            want.setdefault("first_win", ts)
            want.setdefault("defender" if role == "defendant" else "prosecutor", ts)
            if run == 3:
                want.setdefault("streak_3", ts)
        assert {b: t for (u, b), t in badges.items() if u == user} == want
        assert summary[user] == (max(runs), sum(r >= 3 for r in runs))


def test_numbering_of_a_hot_group(spark, ranges):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else f"k{i % 40}", rng.randint(0, 90), i, rng.randint(-5, 5)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, a int, b int, v int").repartition(6)
    got = {r.b: r.n for r in numbered(df, ["k"], ["a", "b"]).collect()}
    sums = {r.b: r.s for r in running_totals(df, ["k"], ["a", "b"], {"s": F.col("v")}).collect()}
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3])
        assert [got[r[2]] for r in group] == list(range(1, len(group) + 1))
        assert [sums[r[2]] for r in group] == [sum(x[3] for x in group[: i + 1]) for i in range(len(group))]


def test_a_single_group_with_equal_times_is_cut(spark, monkeypatch):
    """One key, one time: the ranges are cut by what tells the rows apart."""
    from casebook.operators import ordering

    tables = []
    written = ordering.written
    monkeypatch.setattr(ordering, "written", lambda df, name: tables.append(written(df, name)) or tables[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(1, 0, i) for i in range(4000)], "k int, t int, id int").repartition(5)
        got = {r.id: r.n for r in numbered(df, ["k"], ["t", "id"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: i + 1 for i in range(4000)}
    parts = [r["count"] for r in tables[0].groupBy("_part").count().collect()]
    assert len(parts) == 8 and max(parts) < 1500


def test_first_k_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, i) for i in range(50)], "k int, v int").repartition(4)
    top = first_k(df, ["k"], [F.col("v").desc()], 3)
    assert sorted(r.v for r in top.collect()) == [47, 48, 49]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
