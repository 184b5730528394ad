"""Session report: log to scores, grade and badges."""

from __future__ import annotations

from pyspark.sql import DataFrame

from casebook.operators.scoring import session_scores, with_grade, with_total
from casebook.operators.sessions import time_remaining


def score_sessions(actions: DataFrame, settings: DataFrame, base: DataFrame) -> DataFrame:
    """Scores, total and grade of each session."""
    played = time_remaining(actions, settings, ("argument_count", "evidence_count"))
    return with_grade(with_total(session_scores(base.join(played, "session_id"))))
