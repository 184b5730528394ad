"""Registered queries: conversation log."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.fixed_values import NO_ANSWER_MESSAGE, NO_CONTEXT_MESSAGE, RETRIEVAL_TOOL
from casebook.functions.labels import clock_label, date_label
from casebook.operators import messages as M
from casebook.operators.routing import dispatch_tool_calls, route
from casebook.plans import inputs
from casebook.plans import sql as S


def _log_with_ids(spark, folder):
    return inputs.conversations(spark, folder).select(
        "conv_id",
        F.concat_ws("-", "conv_id", "turn").alias("msg_id"),
        F.col("turn").alias("seq"),
        "role",
        "text",
    )


def _incoming(spark, folder):
    """Revised assistant messages, and a closing user message per assistant message."""
    replies = inputs.conversations(spark, folder).filter(F.col("role") == "assistant")
    turn = F.col("turn")
    revised = replies.select(
        "conv_id",
        F.concat_ws("-", "conv_id", "turn").alias("msg_id"),
        (turn + 1000).alias("seq"),
        "role",
        F.concat(F.lit("revised: "), "text").alias("text"),
    )
    added = replies.select(
        "conv_id",
        F.concat_ws("-", F.lit("new"), "conv_id", "turn").alias("msg_id"),
        (turn + 2000).alias("seq"),
        F.lit("user").alias("role"),
        F.lit("thanks").alias("text"),
    )
    return revised.unionByName(added)


def log_upsert(spark, folder):
    return M.upsert(_log_with_ids(spark, folder), _incoming(spark, folder))


def system_prepend(spark, folder):
    return M.prepend_system(inputs.conversations(spark, folder), inputs.PROMPT)


def route_intent(spark, folder):
    return inputs.conversations(spark, folder).select(
        "conv_id", "turn", route(F.col("text"), inputs.ROUTE_RULES).alias("route")
    )


def tool_dispatch(spark, folder):
    """Each user message carries up to two calls; the reply texts stand for stored results."""
    log = inputs.conversations(spark, folder)
    call_type = "struct<name:string,args:map<string,string>,id:string>"

    def call(name, call_id):
        return F.struct(
            F.lit(name).alias("name"),
            F.create_map(F.lit("query"), F.col("text")).alias("args"),
            call_id.alias("id"),
        ).cast(call_type)

    given = F.when(F.col("conv_id") % 5 != 0, F.concat_ws("-", F.lit("call"), "conv_id", "turn"))
    known, unknown = call(RETRIEVAL_TOOL, given), call("graph_lookup", given)
    calls = (
        F.when(F.col("turn") % 3 == 0, F.array(unknown, known))
        .when(F.col("turn") % 3 == 1, F.array(unknown))
        .otherwise(F.array(known, known))
    )
    asked = log.filter(F.col("role") == "user")
    replies = log.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    results = (
        asked.join(replies, ["conv_id", "turn"])
        .groupBy(F.col("text").alias("query"))
        .agg(F.min("reply").alias("result"))
    )
    return dispatch_tool_calls(asked.select("conv_id", "turn", calls.alias("tool_calls")), results)


def last_answer(spark, folder):
    return M.last_answer(inputs.conversations(spark, folder))


def history_collect(spark, folder):
    pages = M.history_pages(inputs.conversations(spark, folder))
    lines = F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["text"]))
    return pages.select(
        "conv_id",
        "page",
        F.size("messages").cast("bigint").alias("messages"),
        F.array_join(lines, "\n").alias("history"),
    )


def history_clear(spark, folder):
    return M.clear_history(inputs.conversations(spark, folder), F.col("role") == "system")


def drop_blank(spark, folder):
    return M.drop_blank(inputs.conversations(spark, folder))


def has_bot(spark, folder):
    return M.has_bot(inputs.conversations(spark, folder))


def vi_dates(spark, folder):
    return inputs.events(spark, folder).select(
        "event_id", clock_label(F.col("ts")).alias("clock"), date_label(F.col("ts")).alias("day")
    )


QUERIES = {
    "log_upsert": (
        log_upsert,
        """WITH log AS (
             SELECT conv_id, conv_id || '-' || turn AS msg_id, turn AS seq, role, text FROM conversations
             UNION ALL SELECT conv_id, conv_id || '-' || turn, turn + 1000, role, 'revised: ' || text
               FROM conversations WHERE role = 'assistant'
             UNION ALL SELECT conv_id, 'new-' || conv_id || '-' || turn, turn + 2000, 'user', 'thanks'
               FROM conversations WHERE role = 'assistant')
           SELECT conv_id, msg_id, position, role, text FROM (
             SELECT *, min(seq) OVER (PARTITION BY conv_id, msg_id) AS position,
                    row_number() OVER (PARTITION BY conv_id, msg_id ORDER BY seq DESC) AS rn FROM log)
           WHERE rn = 1""",
    ),
    "system_prepend": (
        system_prepend,
        f"""SELECT conv_id, turn, role, text FROM conversations
            UNION ALL
            SELECT conv_id, -1, 'system', {S.quote(inputs.PROMPT)} FROM (
              SELECT conv_id, arg_min(role, turn) AS first FROM conversations GROUP BY 1)
            WHERE first <> 'system'""",
    ),
    "route_intent": (
        route_intent,
        f"SELECT conv_id, turn, {S.route_case('text')} AS route FROM conversations",
    ),
    "tool_dispatch": (
        tool_dispatch,
        f"""WITH asked AS (SELECT * FROM conversations WHERE role = 'user'),
           results AS (SELECT a.text AS query, min(r.text) AS result FROM asked a
             JOIN conversations r ON r.conv_id = a.conv_id AND r.turn = a.turn + 1 AND r.role = 'assistant'
             GROUP BY 1),
           calls AS (
             SELECT conv_id, turn, text, unnest(CASE turn % 3 WHEN 0 THEN [1] WHEN 2 THEN [0, 1] ELSE [] END) AS call_no
             FROM asked)
           SELECT conv_id, turn, call_no::BIGINT AS call_no,
             CASE WHEN conv_id % 5 = 0 THEN '' ELSE 'call-' || conv_id || '-' || turn END AS tool_call_id,
             'rag_retrieval' AS name, coalesce(result, {S.quote(NO_CONTEXT_MESSAGE)}) AS content
           FROM calls LEFT JOIN results ON results.query = calls.text""",
    ),
    "last_answer": (
        last_answer,
        f"""SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'assistant'), {S.quote(NO_ANSWER_MESSAGE)}) AS answer
            FROM conversations GROUP BY 1""",
    ),
    "history_collect": (
        history_collect,
        """SELECT conv_id, turn // 256 AS page, count(*) AS messages,
                  string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history
           FROM conversations GROUP BY 1, 2""",
    ),
    "history_clear": (
        history_clear,
        """SELECT conv_id, turn, role, text FROM (
             SELECT *, max(turn) FILTER (role = 'system') OVER (PARTITION BY conv_id) AS mark FROM conversations)
           WHERE mark IS NULL OR turn > mark""",
    ),
    "drop_blank": (drop_blank, f"SELECT * FROM conversations WHERE trim(text, {S.TRIM}) <> ''"),
    "has_bot": (
        has_bot,
        "SELECT conv_id, bool_or(role = 'assistant') AS has_bot FROM conversations GROUP BY 1",
    ),
    "vi_dates": (
        vi_dates,
        """SELECT event_id, strftime(ts, '%H:%M') AS clock,
                  day(ts) || '/' || month(ts) || '/' || year(ts) AS day FROM events""",
    ),
}
