"""Registered queries: practice sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions.labels import timer_class, timer_text
from casebook.operators import sessions as O
from casebook.operators.strategy import dangling_links as dangling
from casebook.operators.strategy import linked_evidence, live_arguments
from casebook.plans import inputs
from casebook.plans import sql as S


def _log(spark, folder):
    return inputs.session_log(spark, folder), inputs.session_settings(spark, folder)


def scenario_lookup(spark, folder):
    """Order lines look up their part; the key arrives as text, as in a route.

    The seventh lines ask for parts that there are none of.
    """
    asked = F.when(F.col("l_linenumber") == 7, -F.col("l_partkey")).otherwise(F.col("l_partkey"))
    lines = inputs.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", asked.cast("string").alias("key")
    )
    part = inputs.table(spark, folder, "part").select("p_partkey", "p_name")
    found = O.lookup_scenarios(lines, part, "key", "p_partkey")
    return found.select(
        "l_orderkey", "l_linenumber", "found", F.coalesce("p_name", F.lit("")).alias("p_name")
    )


def _lines(spark, folder):
    return O.split_lines(inputs.documents(spark, folder), ["doc_id"])


def line_split(spark, folder):
    return _lines(spark, folder)


def facts_explode(spark, folder):
    """Words of every line are its items: how often each stands at which number."""
    spaced = inputs.documents(spark, folder).select("doc_id", F.split("text", "[ \n]", -1).alias("items"))
    items = O.number_items(spaced, ["doc_id"], F.col("items"))
    return items.groupBy("item").agg(
        F.count("*").alias("uses"), F.min("number").alias("first_number")
    )


def session_merge(spark, folder):
    merged = O.merge_documents(
        inputs.session_patches(spark, folder),
        "session_id",
        ["ts", "event_id"],
        "patch",
        ["role", "scenarioId", "coach", "objective", "settings", "strategy", "completed"],
    )
    return merged


def round_number(spark, folder):
    log, _ = _log(spark, folder)
    return O.round_numbers(log).select(
        "session_id", "event_id", "kind", F.coalesce("round", F.lit(0)).alias("round")
    )


def objection_limit(spark, folder):
    return O.kept_objections(*_log(spark, folder)).select(
        "session_id", "event_id", "n", "limit", "remaining"
    )


def objection_balance(spark, folder):
    return O.objection_balance(*_log(spark, folder))


def pause_accept(spark, folder):
    return O.pause_rows(O.accepted_pauses(*_log(spark, folder)))


def time_remaining(spark, folder):
    return O.time_remaining(*_log(spark, folder))


def timer_label(spark, folder):
    left = F.col("time_remaining")
    return O.time_remaining(*_log(spark, folder)).select(
        "session_id",
        timer_class(left).alias("class"),
        timer_text(left).alias("clock"),
        timer_text(left, pad_minutes=False).alias("result_clock"),
    )


def session_close(spark, folder):
    return O.close_sessions(*_log(spark, folder))


def _arguments(spark, folder):
    sessions = inputs.session_settings(spark, folder).select("session_id")
    return live_arguments(inputs.argument_edits(spark, folder), sessions)


def argument_edits(spark, folder):
    return _arguments(spark, folder)


def link_parity(spark, folder):
    return linked_evidence(inputs.link_toggles(spark, folder))


def dangling_links(spark, folder):
    return dangling(link_parity(spark, folder), _arguments(spark, folder))


_BASE = f"{S.SESSION_LOG}, {S.SETTINGS}"

_FIELDS = {
    "role": ("click", "view"),
    "scenarioId": ("click",),
    "coach": ("view",),
    "objective": ("error",),
    "settings": ("error", "purchase"),
    "strategy": ("purchase",),
    "completed": ("signup",),
}


def _latest(field: str, kinds: tuple[str, ...]) -> str:
    kinds_sql = ", ".join(f"'{k}'" for k in kinds)
    return f"""(list(CASE WHEN {S.K} % 5 <> 0 THEN event_type || '-' || event_id END
        ORDER BY ts DESC, event_id DESC) FILTER (event_type IN ({kinds_sql})))[1] AS {field}"""


QUERIES = {
    "scenario_lookup": (
        scenario_lookup,
        """SELECT l_orderkey, l_linenumber, p_partkey IS NOT NULL AS found, coalesce(p_name, '') AS p_name
           FROM lineitem LEFT JOIN part ON p_partkey = CASE WHEN l_linenumber = 7 THEN -l_partkey ELSE l_partkey END""",
    ),
    "line_split": (
        line_split,
        f"""WITH {S.DOCS}
            SELECT doc_id, unnest(range(1, len(a) + 1)) AS number, unnest(a) AS line
            FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM docs)""",
    ),
    "facts_explode": (
        facts_explode,
        f"""WITH {S.DOCS}
            SELECT item, count(*) AS uses, min(number) AS first_number FROM (
              SELECT unnest(range(1, len(a) + 1)) AS number, unnest(a) AS item
              FROM (SELECT string_split(replace(text, chr(10), ' '), ' ') AS a FROM docs))
            GROUP BY 1""",
    ),
    "session_merge": (
        session_merge,
        "SELECT {} AS session_id, {} FROM events GROUP BY 1".format(
            S.SESSION_ID, ", ".join(_latest(f, k) for f, k in _FIELDS.items())
        ),
    ),
    "round_number": (
        round_number,
        f"""WITH {S.SESSION_LOG}
            SELECT session_id, event_id, kind, least(n, 4)::BIGINT AS round FROM (
              SELECT *, count(*) FILTER (kind = 'user_message')
                OVER (PARTITION BY session_id ORDER BY offset_s, event_id) AS n FROM session_log)
            WHERE kind IN ('user_message', 'opponent_message')""",
    ),
    "objection_limit": (
        objection_limit,
        f"""WITH {_BASE}
            SELECT session_id, event_id, n, objection_limit AS "limit", objection_limit - n AS remaining FROM (
              SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY offset_s, event_id) AS n
              FROM session_log WHERE kind = 'objection') JOIN settings USING (session_id)
            WHERE n <= objection_limit""",
    ),
    "objection_balance": (
        objection_balance,
        f"""WITH {_BASE}
            SELECT session_id, objection_limit AS "limit", pressed, least(pressed, objection_limit) AS kept,
                   objection_limit - least(pressed, objection_limit) AS remaining
            FROM settings JOIN (SELECT session_id, count(*) FILTER (kind = 'objection') AS pressed
                                FROM session_log GROUP BY 1) USING (session_id)""",
    ),
    "pause_accept": (
        pause_accept,
        f"""WITH {_BASE}, {S.PAUSES}
            SELECT session_id, 1::BIGINT AS n, t AS offset_s FROM a1
            UNION ALL SELECT session_id, 2, t FROM a2 UNION ALL SELECT session_id, 3, t FROM a3""",
    ),
    "time_remaining": (
        time_remaining,
        f"WITH {_BASE}, {S.PAUSES}, {S.REMAINING} SELECT * FROM remaining",
    ),
    "timer_label": (
        timer_label,
        f"""WITH {_BASE}, {S.PAUSES}, {S.REMAINING}
            SELECT session_id,
              CASE WHEN time_remaining <= 60 THEN 'critical' WHEN time_remaining <= 180 THEN 'warning' ELSE '' END AS class,
              printf('%02d:%02d', time_remaining // 60, time_remaining % 60) AS clock,
              printf('%d:%02d', time_remaining // 60, time_remaining % 60) AS result_clock
            FROM remaining""",
    ),
    "session_close": (
        session_close,
        f"""WITH {_BASE}, {S.PAUSES},
            s AS (SELECT session_id, min(offset_s) AS start_s, min(offset_s) FILTER (kind = 'end') AS end_s
                  FROM session_log GROUP BY 1),
            d0 AS (SELECT s.*, start_s + time_limit_min * 60 AS d FROM s JOIN settings USING (session_id)),
            d1 AS (SELECT d0.* REPLACE (d + CASE WHEN a1.t < d THEN 10 ELSE 0 END AS d) FROM d0 LEFT JOIN a1 USING (session_id)),
            d2 AS (SELECT d1.* REPLACE (d + CASE WHEN a2.t < d THEN 10 ELSE 0 END AS d) FROM d1 LEFT JOIN a2 USING (session_id)),
            d3 AS (SELECT d2.* REPLACE (d + CASE WHEN a3.t < d THEN 10 ELSE 0 END AS d) FROM d2 LEFT JOIN a3 USING (session_id)),
            c AS (SELECT session_id, d, least(d, coalesce(end_s, d)) AS closed_s,
                         CASE WHEN end_s <= d THEN 'ended' ELSE 'time_up' END AS reason FROM d3)
            SELECT c.session_id, closed_s::BIGINT AS closed_s, reason, count(*) AS actions_kept,
              least(1 + count(*) FILTER (kind = 'user_message'), 4)::BIGINT AS rounds_completed,
              (d - closed_s)::BIGINT AS time_remaining
            FROM c JOIN session_log l ON l.session_id = c.session_id AND l.offset_s <= closed_s
            GROUP BY c.session_id, closed_s, reason, d""",
    ),
    "argument_edits": (
        argument_edits,
        f"WITH RECURSIVE {_BASE}, {S.ARGUMENTS} SELECT * FROM arguments",
    ),
    "link_parity": (link_parity, f"WITH {S.LINKS} SELECT * FROM links"),
    "dangling_links": (
        dangling_links,
        f"""WITH RECURSIVE {_BASE}, {S.ARGUMENTS}, {S.LINKS}
            SELECT * FROM links l WHERE NOT EXISTS (
              SELECT 1 FROM arguments a WHERE a.session_id = l.session_id AND a.arg_id = l.argument_id)""",
    ),
}
