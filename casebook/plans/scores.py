"""Registered queries: scores, grades, badges, careers."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions.labels import date_label
from casebook.operators import badges as B
from casebook.operators.scoring import SCORES, earned_badges
from casebook.plans import inputs
from casebook.plans import sql as S
from casebook.plans.report import score_sessions


def _scored(spark, folder):
    settings = inputs.session_settings(spark, folder)
    return score_sessions(
        inputs.session_log(spark, folder), settings, inputs.session_base(settings)
    )


def session_scores(spark, folder):
    return _scored(spark, folder).select("session_id", *SCORES, "total")


def grade(spark, folder):
    return _scored(spark, folder).groupBy("grade", "label").agg(
        F.count("*").alias("sessions"), F.sum("total").alias("points")
    )


def badge_rules(spark, folder):
    return earned_badges(_scored(spark, folder)).select(
        "session_id", F.col("position").cast("bigint").alias("position"), "badge_id"
    )


def session_badge_tally(spark, folder):
    """From the session log to each user's tally."""
    ended = inputs.session_log(spark, folder).groupBy("session_id").agg(F.max("ts").alias("ts"))
    earned = earned_badges(_scored(spark, folder)).join(ended, "session_id")
    return B.tally(earned.select("user_id", "badge_id", "ts"))


def badge_tally(spark, folder):
    return B.tally(inputs.earned_events(spark, folder))


def badge_tally_merge(spark, folder):
    """The tally of the first half of the month, brought up to date with the rest."""
    earned = inputs.earned_events(spark, folder)
    early = F.dayofmonth("ts") <= 15
    return B.merge_tallies(B.tally(earned.filter(early)), B.tally(earned.filter(~early)))


def badge_status(spark, folder):
    users = inputs.events(spark, folder).select("user_id").distinct()
    status = B.collection_status(users, badge_tally(spark, folder))
    return status.withColumn("last_day", date_label(F.col("last_earned"))).drop("last_earned")


def badge_totals(spark, folder):
    return B.collection_totals(badge_tally(spark, folder))


def streaks(spark, folder):
    return B.streak_summary(B.win_streaks(inputs.completed_sessions(spark, folder)))


def career_badges(spark, folder):
    return B.career_badges(inputs.completed_sessions(spark, folder))


_SCORED = f"{S.SESSION_LOG}, {S.SETTINGS}, {S.PAUSES}, {S.REMAINING}, {S.SCORES}"
_RULES = """
rules AS (
  SELECT session_id, user_id, unnest(b) AS badge_id, unnest(range(0, len(b))) AS position FROM (
    SELECT session_id, user_id, list_filter([
      CASE WHEN total > 400 THEN 'excellent' END, CASE WHEN evidence_use > 90 THEN 'evidence' END,
      CASE WHEN persuasion > 90 THEN 'persuader' END, CASE WHEN legal_accuracy > 95 THEN 'accurate' END,
      CASE WHEN etiquette = 100 THEN 'polite' END, CASE WHEN time_management > 90 THEN 'speed' END],
      lambda x: x IS NOT NULL) AS b FROM scored))"""

_TALLY_SQL = f"WITH {S.TALLY} SELECT * FROM tally"

QUERIES = {
    "session_scores": (
        session_scores,
        f"""WITH {_SCORED} SELECT session_id, legal_accuracy, evidence_use, persuasion,
            time_management, etiquette, total FROM scored""",
    ),
    "grade": (
        grade,
        f"""WITH {_SCORED} SELECT grade, label, count(*) AS sessions, sum(total)::BIGINT AS points FROM (
              SELECT total,
                CASE WHEN total >= 450 THEN 'S' WHEN total >= 400 THEN 'A' WHEN total >= 350 THEN 'B'
                     WHEN total >= 300 THEN 'C' ELSE 'D' END AS grade,
                CASE WHEN total >= 450 THEN 'Xuất sắc!' WHEN total >= 400 THEN 'Rất tốt!'
                     WHEN total >= 350 THEN 'Tốt' WHEN total >= 300 THEN 'Khá' ELSE 'Cần cải thiện' END AS label
              FROM scored) GROUP BY 1, 2""",
    ),
    "badge_rules": (
        badge_rules,
        f"WITH {_SCORED}, {_RULES} SELECT session_id, position, badge_id FROM rules",
    ),
    "session_badge_tally": (
        session_badge_tally,
        f"""WITH {_SCORED}, {_RULES}
            SELECT user_id, badge_id, count(*) AS cnt, max(ts) AS last_earned
            FROM rules JOIN (SELECT session_id, max(ts) AS ts FROM session_log GROUP BY 1) USING (session_id)
            GROUP BY 1, 2""",
    ),
    "badge_tally": (badge_tally, _TALLY_SQL),
    "badge_tally_merge": (badge_tally_merge, _TALLY_SQL),
    "badge_status": (
        badge_status,
        f"""WITH {S.TALLY}, catalogue AS (SELECT * FROM (VALUES {', '.join(
            f"({S.quote(b[0])}, {S.quote(b[1])}, {S.quote(b[2])})" for b in S.BADGES)}) AS c(badge_id, name, icon))
            SELECT user_id, badge_id, name, cnt IS NOT NULL AS unlocked,
              CASE WHEN cnt IS NULL THEN '🔒' ELSE icon END AS shown_icon, coalesce(cnt, 0) AS cnt,
              CASE WHEN cnt IS NULL THEN '' ELSE day(last_earned) || '/' || month(last_earned) || '/' || year(last_earned) END AS last_day
            FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN catalogue LEFT JOIN tally USING (user_id, badge_id)""",
    ),
    "badge_totals": (
        badge_totals,
        f"""WITH {S.TALLY} SELECT user_id, count(*) AS unlocked, sum(cnt)::BIGINT AS times_earned,
              round(100.0 * count(*) / {len(S.BADGES)})::BIGINT AS percent FROM tally GROUP BY 1""",
    ),
    "streaks": (
        streaks,
        f"""WITH {S.WINS} SELECT user_id, max(length) AS longest, count(*) FILTER (length >= 3) AS streaks
            FROM (SELECT user_id, run, count(*) AS length FROM won_runs GROUP BY 1, 2) GROUP BY 1""",
    ),
    "career_badges": (
        career_badges,
        f"""WITH {S.WINS}
            SELECT user_id, 'first_win' AS badge_id, min(ts) AS earned_at FROM played WHERE won GROUP BY 1
            UNION ALL SELECT user_id, 'streak_3', min(ts) FROM (
              SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS m FROM won_runs)
              WHERE m = 3 GROUP BY 1
            UNION ALL SELECT user_id, 'master', ts FROM numbered WHERE n = 10
            UNION ALL SELECT user_id, 'defender', min(ts) FROM played WHERE won AND role = 'defendant' GROUP BY 1
            UNION ALL SELECT user_id, 'prosecutor', min(ts) FROM played WHERE won AND role = 'plaintiff' GROUP BY 1""",
    ),
}
