"""Tables of the test data, and the views derived from them.

Every view covers its whole table; the same definitions stand in ``sql.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.fixed_values import BADGES
from casebook.functions.text import text_bucket
from casebook.sources.catalogues import FaqEntry
from casebook.sources.documents import load_documents

# Keywords that occur in the four languages of the test documents.
FAQ = [
    FaqEntry("mentre", "L-mentre", "N-mentre", "lc0", "lp0", "nc0", "np0"),
    FaqEntry("keit", "L-keit", "N-keit", "lc1", "lp1", "nc1", "np1"),
    FaqEntry("heer", "L-heer", "N-heer", "lc2", None, "nc2", "np2"),
    FaqEntry("ación", "L-ación", "N-ación", "lc3", "lp3", None, "np3"),
]
FAQ_DEFAULT = FaqEntry("default", "L-default", "N-default", "lc4", "lp4", "nc4", "np4")

# Routing rules for the languages of the test conversations.
ROUTE_RULES = [
    ("direct", "^(in|and|la|is|der) "),
    ("retrieve", "(tion|keit|ment)"),
    ("direct", "[.]$"),
]

PROMPT = "Answer from the retrieved passages."


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark, folder) -> DataFrame:
    return load_documents(spark, f"{folder}/documents.parquet")


def conversations(spark, folder) -> DataFrame:
    return table(spark, folder, "conversations")


def events(spark, folder) -> DataFrame:
    return table(spark, folder, "events")


def vectors(spark, folder) -> tuple[DataFrame, DataFrame]:
    """The embeddings as queries and as the collection."""
    emb = table(spark, folder, "embeddings")
    queries = emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    items = emb.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    return queries, items


VECTOR_DIM = 64


def request_payloads(spark, folder) -> DataFrame:
    """One JSON request per document; options are missing, null or set."""
    doc = F.col("doc_id")
    options = F.map_concat(
        F.when(doc % 3 == 0, F.create_map(F.lit("character"), F.lit("lawyer")))
        .when(doc % 3 == 1, F.create_map(F.lit("character"), F.lit("normal")))
        .otherwise(F.expr("cast(map() as map<string,string>)")),
        F.when(
            doc % 7 != 0, F.create_map(F.lit("toneValue"), (doc % 101).cast("string"))
        ).otherwise(F.expr("cast(map() as map<string,string>)")),
        F.when(doc % 4 == 1, F.create_map(F.lit("illustrationType"), F.lit("comic")))
        .when(doc % 4 == 2, F.create_map(F.lit("illustrationType"), F.lit("poster")))
        .when(doc % 4 == 3, F.create_map(F.lit("illustrationType"), F.lit(None).cast("string")))
        .otherwise(F.expr("cast(map() as map<string,string>)")),
    )
    question = F.when(doc % 11 != 0, F.col("text"))
    return table(spark, folder, "documents").select(
        "doc_id",
        F.to_json(F.struct(question.alias("question"), options.alias("options"))).alias("payload"),
    )


def props_k():
    return F.from_json("props", "map<string,int>")["k"].cast("bigint")


def _session_id():
    return F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 7)


def session_log(spark, folder) -> DataFrame:
    return session_log_of(events(spark, folder))


def session_log_of(events: DataFrame) -> DataFrame:
    """One row per action: a session is a user's week, squeezed to 700 seconds."""
    week_seconds = (
        ((F.dayofmonth("ts") - 1) % 7) * 86400
        + F.hour("ts") * 3600
        + F.minute("ts") * 60
        + F.floor(F.second("ts"))
    )
    kind = (
        F.when(F.col("value") > 200, "end")
        .when(F.col("event_type") == "click", "user_message")
        .when(F.col("event_type") == "view", "opponent_message")
        .when(F.col("event_type") == "error", "objection")
        .when(F.col("event_type") == "purchase", "evidence")
        .otherwise("pause")
    )
    return events.select(
        _session_id().cast("bigint").alias("session_id"),
        "user_id",
        "event_id",
        "ts",
        F.floor(week_seconds / 864).cast("bigint").alias("offset_s"),
        kind.alias("kind"),
        props_k().alias("k"),
    )


def session_settings(spark, folder) -> DataFrame:
    """One row per session; a limit of 0 falls back on its default."""
    sid = F.col("session_id")
    sessions = events(spark, folder).select(
        _session_id().cast("bigint").alias("session_id"), "user_id"
    ).distinct()
    return sessions.select(
        "session_id",
        "user_id",
        F.get(F.array(*[F.lit(x) for x in (5, 10, 15, 20, 0)]), (sid % 5).cast("int")).alias("time_limit_min"),
        F.get(F.array(*[F.lit(x) for x in (2, 3, 5, 0)]), (sid % 4).cast("int")).alias("objection_limit"),
        (sid % 2 == 0).alias("pause_enabled"),
        F.when(sid % 3 == 0, "plaintiff").otherwise("defendant").alias("role"),
    )


def argument_edits(spark, folder) -> DataFrame:
    log = session_log(spark, folder)
    op = (
        F.when(F.col("kind") == "evidence", "add")
        .when(F.col("kind") == "opponent_message", "replace")
        .when(F.col("kind") == "objection", "remove")
    )
    return log.select(
        "session_id",
        "offset_s",
        "event_id",
        op.alias("op"),
        (F.col("k") % 3 + 1).alias("arg_id"),
        F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("text"),
    ).filter(F.col("op").isNotNull())


def link_toggles(spark, folder) -> DataFrame:
    return events(spark, folder).select(
        _session_id().cast("bigint").alias("session_id"),
        F.col("event_type").alias("evidence_id"),
        (props_k() % 4 + 1).alias("argument_id"),
    )


def session_patches(spark, folder) -> DataFrame:
    """Each event is one stage that writes some fields of its session document."""
    kind = F.col("event_type")
    value = F.when(F.col("k") % 5 != 0, F.concat(F.col("event_type"), F.lit("-"), F.col("event_id").cast("string")))
    fields = (
        F.when(kind == "click", F.array(F.lit("role"), F.lit("scenarioId")))
        .when(kind == "view", F.array(F.lit("coach"), F.lit("role")))
        .when(kind == "error", F.array(F.lit("objective"), F.lit("settings")))
        .when(kind == "purchase", F.array(F.lit("strategy"), F.lit("settings")))
        .otherwise(F.array(F.lit("completed")))
    )
    return (
        events(spark, folder)
        .withColumn("k", props_k())
        .select(
            _session_id().cast("bigint").alias("session_id"),
            "ts",
            "event_id",
            F.map_from_arrays(fields, F.transform(fields, lambda f: value)).alias("patch"),
        )
    )


def session_base(settings: DataFrame) -> DataFrame:
    """Base scores in their usual ranges, derived from the session id."""

    def bucket(name: str, span: int):
        return text_bucket(F.concat(F.col("session_id").cast("string"), F.lit(name)), span)

    return settings.select(
        "session_id",
        "user_id",
        (bucket("legal", 30) + 60).alias("legal_base"),
        (bucket("evidence", 30) + 60).alias("evidence_base"),
        (bucket("persuasion", 30) + 60).alias("persuasion_base"),
        (bucket("etiquette", 20) + 75).alias("etiquette_base"),
    )


def earned_badges(rows: DataFrame) -> DataFrame:
    """Every event stands for an earned badge; which ones a user can earn depends on the user."""
    names = F.array(*[F.lit(b[0]) for b in BADGES])
    within = F.pmod(F.col("user_id"), F.lit(len(BADGES))) + 1
    badge = F.get(names, (props_k() % within).cast("int"))
    return rows.select("user_id", badge.alias("badge_id"), "ts")


def earned_events(spark, folder) -> DataFrame:
    return earned_badges(events(spark, folder))


def completed_sessions(spark, folder) -> DataFrame:
    """Events stand for completed sessions; a value above 20 is a win."""
    return events(spark, folder).select(
        "user_id",
        "ts",
        "event_id",
        F.when(F.col("event_id") % 3 == 0, "plaintiff").otherwise("defendant").alias("role"),
        (F.col("value") > 20).alias("won"),
    )
