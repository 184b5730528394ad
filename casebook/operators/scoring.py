"""Session scores, grades and earned badges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook import fixed_values as V
from casebook.functions.labels import grade, grade_label

SCORES = ["legal_accuracy", "evidence_use", "persuasion", "time_management", "etiquette"]


def time_score(seconds_left: Column) -> Column:
    return F.when(
        seconds_left > 0,
        V.TIME_SCORE_BASE + F.floor(seconds_left / V.TIME_SCORE_STEP_SECONDS),
    ).otherwise(V.TIME_SCORE_NONE_LEFT)


def _bonus(count: Column, above: int, points: int) -> Column:
    return F.when(F.coalesce(count, F.lit(0)) > above, points).otherwise(0)


def session_scores(df: DataFrame) -> DataFrame:
    """The five scores of each session. No score is capped.

    Reads legal_base, evidence_base, persuasion_base, etiquette_base,
    time_remaining, argument_count and evidence_count.
    """
    scores = {
        "legal_accuracy": F.col("legal_base"),
        "evidence_use": F.col("evidence_base")
        + _bonus(F.col("evidence_count"), V.EVIDENCE_BONUS_ABOVE, V.EVIDENCE_BONUS),
        "persuasion": F.col("persuasion_base")
        + _bonus(F.col("argument_count"), V.ARGUMENT_BONUS_ABOVE, V.ARGUMENT_BONUS),
        "time_management": time_score(F.col("time_remaining")),
        "etiquette": F.col("etiquette_base"),
    }
    return df.withColumns({name: value.cast("bigint") for name, value in scores.items()})


def with_total(df: DataFrame) -> DataFrame:
    total = F.col(SCORES[0])
    for name in SCORES[1:]:
        total = total + F.col(name)
    return df.withColumn("total", total)


def with_grade(df: DataFrame) -> DataFrame:
    return df.withColumns({"grade": grade(F.col("total")), "label": grade_label(F.col("total"))})


def earned_badges(df: DataFrame) -> DataFrame:
    """One row per earned badge with its position in the rule order."""
    rules = [
        ("excellent", F.col("total") > V.BADGE_TOTAL_ABOVE),
        ("evidence", F.col("evidence_use") > V.BADGE_EVIDENCE_ABOVE),
        ("persuader", F.col("persuasion") > V.BADGE_PERSUASION_ABOVE),
        ("accurate", F.col("legal_accuracy") > V.BADGE_LEGAL_ABOVE),
        ("polite", F.col("etiquette") == V.BADGE_ETIQUETTE_EQUALS),
        ("speed", F.col("time_management") > V.BADGE_TIME_ABOVE),
    ]
    earned = F.filter(
        F.array(*[F.when(test, F.lit(badge)) for badge, test in rules]), lambda b: b.isNotNull()
    )
    return df.withColumn("_badges", earned).select(
        *df.columns, F.posexplode("_badges").alias("position", "badge_id")
    )
