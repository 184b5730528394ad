"""Badge tallies, collection status and career badges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook import fixed_values as V
from casebook.operators.ordering import first_k, running_totals


def tally(earned: DataFrame) -> DataFrame:
    """``earned(user_id, badge_id, ts)`` to (user_id, badge_id, cnt, last_earned)."""
    return earned.groupBy("user_id", "badge_id").agg(
        F.count("*").alias("cnt"), F.max("ts").alias("last_earned")
    )


def merge_tallies(stored: DataFrame, change: DataFrame) -> DataFrame:
    """Sum of two tallies: counts add up, the later time wins."""
    return (
        stored.unionByName(change)
        .groupBy("user_id", "badge_id")
        .agg(F.sum("cnt").alias("cnt"), F.max("last_earned").alias("last_earned"))
    )


def _catalogue_array():
    return F.array(
        *[
            F.struct(F.lit(row[0]).alias("badge_id"), F.lit(row[1]).alias("name"), F.lit(row[2]).alias("icon"))
            for row in V.BADGES
        ]
    )


def collection_status(users: DataFrame, tallies: DataFrame) -> DataFrame:
    """Every user with every badge of the catalogue, locked or unlocked.

    The catalogue is a literal array, so each user row grows by its fixed length;
    there is no join with it.
    """
    slots = users.select("user_id", F.explode(_catalogue_array()).alias("_b")).select(
        "user_id", "_b.badge_id", "_b.name", "_b.icon"
    )
    return slots.join(tallies, ["user_id", "badge_id"], "left").select(
        "user_id",
        "badge_id",
        "name",
        F.col("cnt").isNotNull().alias("unlocked"),
        F.when(F.col("cnt").isNull(), "🔒").otherwise(F.col("icon")).alias("shown_icon"),
        F.coalesce("cnt", F.lit(0)).alias("cnt"),
        "last_earned",
    )


def collection_totals(tallies: DataFrame) -> DataFrame:
    """Per user: badges unlocked, times earned, percent of the catalogue."""
    size = len(V.BADGES)
    return (
        tallies.groupBy("user_id")
        .agg(F.count("*").alias("unlocked"), F.sum("cnt").alias("times_earned"))
        .withColumn("percent", F.round(100 * F.col("unlocked") / size).cast("bigint"))
    )


def win_streaks(sessions: DataFrame) -> DataFrame:
    """Won sessions with the number of their run of consecutive wins.

    ``sessions(user_id, ts, event_id, won)``. Wins of one run have the same number
    of lost sessions before them.
    """
    lost = {"run": F.when(F.col("won"), 0).otherwise(1)}
    return running_totals(sessions, ["user_id"], ["ts", "event_id"], lost).filter("won")


def streak_summary(runs: DataFrame) -> DataFrame:
    """Per user with a win: longest run of wins, and runs that reach the badge length."""
    lengths = runs.groupBy("user_id", "run").agg(F.count("*").alias("length"))
    return lengths.groupBy("user_id").agg(
        F.max("length").alias("longest"),
        F.count_if(F.col("length") >= V.STREAK_LENGTH).alias("streaks"),
    )


def career_badges(sessions: DataFrame) -> DataFrame:
    """(user_id, badge_id, earned_at) of the badges that depend on past sessions.

    ``sessions(user_id, ts, event_id, role, won)``, one row per completed session.
    """
    order = [F.col("ts"), F.col("event_id")]

    def first_time(test: Column) -> Column:
        return F.min(F.when(test, F.col("ts")))

    won = F.col("won")
    wins = (
        sessions.groupBy("user_id")
        .agg(
            first_time(won).alias("first_win"),
            first_time(won & (F.col("role") == "defendant")).alias("defender"),
            first_time(won & (F.col("role") == "plaintiff")).alias("prosecutor"),
        )
        .unpivot("user_id", ["first_win", "defender", "prosecutor"], "badge_id", "earned_at")
        .filter(F.col("earned_at").isNotNull())
    )

    def nth(df: DataFrame, keys: list[str], n: int, badge: str) -> DataFrame:
        reached = first_k(df, keys, order, n).filter(F.col("n") == n)
        return reached.groupBy("user_id").agg(F.min("ts").alias("earned_at")).select(
            "user_id", F.lit(badge).alias("badge_id"), "earned_at"
        )

    streak = nth(win_streaks(sessions), ["user_id", "run"], V.STREAK_LENGTH, "streak_3")
    master = nth(sessions, ["user_id"], V.MASTER_SESSIONS, "master")
    return wins.unionByName(streak).unionByName(master)
