"""Operators on practice-session logs.

``actions(session_id, event_id, offset_s, kind)`` holds one row per action, ordered
within a session by (offset_s, event_id). Settings are one row per session:
``settings(session_id, time_limit_min, objection_limit, pause_enabled)``.

Everything per session is an aggregate or a bounded first-k, both of which are
combined before the shuffle; no session is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook import fixed_values as V
from casebook.operators.ordering import GROUP_LIMIT, first_k, numbered
from casebook.schemas import SESSION_FIELDS

ORDER = ["offset_s", "event_id"]


def or_default(value: Column, default: int) -> Column:
    """Zero falls back on the default, like a missing value."""
    return F.coalesce(F.nullif(value, F.lit(0)), F.lit(default))


def time_limit_seconds(minutes: Column) -> Column:
    return or_default(minutes, V.DEFAULT_TIME_LIMIT_MIN).cast("bigint") * 60


def lookup_scenarios(df: DataFrame, scenarios: DataFrame, key: str, scenario_id: str = "id") -> DataFrame:
    """Left lookup by integer id; ``found`` flags the matches. Ids are unique.

    A text key counts by the integer it begins with, as in a route.
    """
    right = scenarios.withColumn("_id", F.col(scenario_id).cast("bigint"))
    if scenario_id != key:
        right = right.drop(scenario_id)
    leading = F.regexp_extract(F.col(key).cast("string"), r"^\s*([+-]?\d+)", 1)
    left = df.withColumn("_id", leading.try_cast("bigint"))
    return (
        left.join(right.withColumn("_hit", F.lit(True)), "_id", "left")
        .withColumn("found", F.coalesce("_hit", F.lit(False)))
        .drop("_id", "_hit")
    )


def number_items(df: DataFrame, keys: list[str], items: Column, name: str = "item") -> DataFrame:
    """One row per array item, numbered from 1."""
    return df.select(*keys, F.posexplode(items).alias("_at", name)).select(
        *keys, (F.col("_at") + 1).cast("bigint").alias("number"), name
    )


def split_lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per line, blank lines kept."""
    return number_items(df, keys, F.split(F.col(text), "\n", -1), "line")


def merge_documents(
    patches: DataFrame,
    key: str,
    order: list[str],
    patch: str = "patch",
    fields: list[str] = SESSION_FIELDS,
) -> DataFrame:
    """Shallow merge of staged documents: each field takes its latest value.

    ``patch`` is map<string,string>. A stage overwrites only the fields it carries,
    and an explicit null overwrites too.
    """
    at = F.struct(*order)

    def latest(field: str) -> Column:
        carried = F.map_contains_key(patch, field)
        value = F.struct(F.col(patch)[field].alias("v"))
        return F.max_by(value, F.when(carried, at))["v"].alias(field)

    return patches.groupBy(key).agg(*[latest(f) for f in fields])


def round_numbers(actions: DataFrame) -> DataFrame:
    """Round of each user message, at most the last round, and of each reply.

    The round of a message is one more than the number of earlier user messages,
    so the first few user messages of a session decide all its rounds.
    """
    user = actions.filter(F.col("kind") == "user_message")
    heads = (
        first_k(user, ["session_id"], [F.col(c) for c in ORDER], V.TOTAL_ROUNDS)
        .groupBy("session_id")
        .agg(F.collect_list(F.struct(*ORDER)).alias("_heads"))
    )
    here = F.struct(*ORDER)
    talk = actions.filter(F.col("kind").isin("user_message", "opponent_message"))
    upto = F.size(F.filter("_heads", lambda h: h <= here))
    before = F.size(F.filter("_heads", lambda h: h < here)) + 1
    number = F.when(F.col("kind") == "opponent_message", upto).otherwise(
        F.least(before, F.lit(V.TOTAL_ROUNDS))
    )
    # A reply before any user message answers nothing and has no round.
    return (
        talk.join(heads, "session_id", "left")
        .withColumn("round", F.nullif(F.coalesce(number, F.lit(0)), F.lit(0)).cast("bigint"))
        .drop("_heads")
    )


def kept_objections(actions: DataFrame, settings: DataFrame) -> DataFrame:
    """The first ``limit`` objections of each session, numbered, with what remains."""
    limits = settings.select(
        "session_id",
        or_default(F.col("objection_limit"), V.DEFAULT_OBJECTION_LIMIT).cast("bigint").alias("limit"),
    )
    # The largest limit bounds what any session can keep.
    most = limits.agg(F.max("limit")).first()[0] or V.DEFAULT_OBJECTION_LIMIT
    pressed = actions.filter(F.col("kind") == "objection")
    if most <= GROUP_LIMIT:
        heads = first_k(pressed, ["session_id"], [F.col(c) for c in ORDER], most)
    else:
        heads = numbered(pressed, ["session_id"], ORDER)
    return (
        heads.join(limits, "session_id")
        .filter(F.col("n") <= F.col("limit"))
        .withColumn("n", F.col("n").cast("bigint"))
        .withColumn("remaining", F.col("limit") - F.col("n"))
    )


def objection_balance(actions: DataFrame, settings: DataFrame) -> DataFrame:
    """Per session: limit, objections pressed, kept and remaining."""
    pressed = actions.groupBy("session_id").agg(
        F.count_if(F.col("kind") == "objection").alias("pressed")
    )
    limit = or_default(F.col("objection_limit"), V.DEFAULT_OBJECTION_LIMIT).cast("bigint")
    return (
        settings.join(pressed, "session_id", "left")
        .select("session_id", limit.alias("limit"), F.coalesce("pressed", F.lit(0)).alias("pressed"))
        .withColumn("kept", F.least("pressed", "limit"))
        .withColumn("remaining", F.col("limit") - F.col("kept"))
    )


def _accept(starts: Column) -> Column:
    """Fold sorted presses into accepted starts: apart far enough, and not too many."""

    def step(taken: Column, press: Column) -> Column:
        over = F.coalesce(F.element_at(taken, -1) + V.PAUSE_SECONDS <= press, F.lit(True))
        fits = (F.size(taken) < V.MAX_PAUSES) & ((F.size(taken) == 0) | over)
        return F.when(fits, F.array_append(taken, press)).otherwise(taken)

    return F.aggregate(starts, F.expr("cast(array() as array<bigint>)"), step)


# Between two accepted pauses lie fewer whole seconds than a pause lasts, so the
# accepted ones are among this many earliest distinct seconds.
PRESSES_NEEDED = (V.MAX_PAUSES - 1) * V.PAUSE_SECONDS + 1


def accepted_pauses(actions: DataFrame, settings: DataFrame) -> DataFrame:
    """Start times of the accepted pauses, one row per session that has any.

    A pause is accepted when pauses are enabled, fewer than the maximum were
    taken and the last accepted one is over. Offsets are whole seconds.
    """
    pressed = (
        actions.filter(F.col("kind") == "pause")
        .select("session_id", F.col("offset_s").cast("bigint").alias("offset_s"))
        .distinct()
    )
    accepted = (
        first_k(pressed, ["session_id"], [F.col("offset_s")], PRESSES_NEEDED)
        .groupBy("session_id")
        .agg(_accept(F.array_sort(F.collect_list("offset_s"))).alias("_taken"))
    )
    enabled = settings.filter("pause_enabled").select("session_id")
    return accepted.join(enabled, "session_id", "left_semi").select(
        "session_id",
        *[F.get("_taken", F.lit(n)).alias(f"pause_{n + 1}") for n in range(V.MAX_PAUSES)],
    )


def pause_rows(accepted: DataFrame) -> DataFrame:
    """Long form of the accepted pauses: (session_id, n, offset_s)."""
    starts = F.array(*[f"pause_{n}" for n in range(1, V.MAX_PAUSES + 1)])
    return (
        accepted.select("session_id", F.posexplode(starts).alias("_at", "offset_s"))
        .filter(F.col("offset_s").isNotNull())
        .select("session_id", (F.col("_at") + 1).cast("bigint").alias("n"), "offset_s")
    )


def _pauses_taken() -> Column:
    taken = [F.when(F.col(f"pause_{n}").isNotNull(), 1).otherwise(0) for n in range(1, V.MAX_PAUSES + 1)]
    total = taken[0]
    for one in taken[1:]:
        total = total + one
    return total


def session_totals(actions: DataFrame) -> DataFrame:
    """Per session: elapsed seconds, user messages and pieces of evidence."""
    return actions.groupBy("session_id").agg(
        (F.max("offset_s") - F.min("offset_s")).alias("elapsed_s"),
        F.count_if(F.col("kind") == "user_message").alias("argument_count"),
        F.count_if(F.col("kind") == "evidence").alias("evidence_count"),
    )


def time_remaining(
    actions: DataFrame, settings: DataFrame, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Seconds left at the last action; accepted pauses do not count.

    ``keep`` names columns of ``session_totals`` to return as well.
    """
    left = F.col("limit_s") - F.col("elapsed_s") + V.PAUSE_SECONDS * F.col("pauses")
    return (
        settings.join(session_totals(actions), "session_id")
        .join(accepted_pauses(actions, settings), "session_id", "left")
        .select(
            "session_id",
            time_limit_seconds(F.col("time_limit_min")).alias("limit_s"),
            "elapsed_s",
            _pauses_taken().cast("bigint").alias("pauses"),
            *keep,
        )
        .withColumn("time_remaining", F.greatest(F.lit(0), left).cast("bigint"))
    )


def close_sessions(actions: DataFrame, settings: DataFrame) -> DataFrame:
    """When and why each session closes, and what it stores then.

    The deadline is the start plus the limit, moved by each pause that began
    before it. Actions after the close are not part of the session.
    """
    is_end = F.col("kind") == "end"
    spans = actions.groupBy("session_id").agg(
        F.min("offset_s").alias("start_s"),
        F.min(F.when(is_end, F.col("offset_s"))).alias("end_s"),
    )
    limits = settings.select(
        "session_id", time_limit_seconds(F.col("time_limit_min")).alias("limit_s")
    )
    deadline = F.col("start_s") + F.col("limit_s")
    for number in range(1, V.MAX_PAUSES + 1):
        began = F.col(f"pause_{number}") < deadline
        deadline = deadline + F.when(began, V.PAUSE_SECONDS).otherwise(0)
    closes = (
        spans.join(limits, "session_id")
        .join(accepted_pauses(actions, settings), "session_id", "left")
        .withColumn("deadline_s", deadline.cast("bigint"))
        .select(
            "session_id",
            "deadline_s",
            F.least("deadline_s", "end_s").alias("closed_s"),
            F.when(F.col("end_s") <= F.col("deadline_s"), "ended").otherwise("time_up").alias("reason"),
        )
    )
    # Counted per second first: what is joined per session is bounded by its length.
    per_second = actions.groupBy("session_id", "offset_s").agg(
        F.count("*").alias("all"), F.count_if(F.col("kind") == "user_message").alias("user")
    )
    rounds = F.least(F.sum("user") + 1, F.lit(V.TOTAL_ROUNDS)).cast("bigint")
    return (
        per_second.join(closes, "session_id")
        .filter(F.col("offset_s") <= F.col("closed_s"))
        .groupBy("session_id", "closed_s", "reason", "deadline_s")
        .agg(F.sum("all").alias("actions_kept"), rounds.alias("rounds_completed"))
        .withColumn("time_remaining", F.col("deadline_s") - F.col("closed_s"))
        .drop("deadline_s")
    )
