"""Operators on conversation logs (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook import fixed_values as V
from casebook.functions.text import trim_input

PAGE_TURNS = 256


def upsert(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append new messages; a message whose id exists replaces it in place.

    Both sides carry (conv_id, msg_id, seq, role, text) with ``seq`` the order of
    arrival. The latest content is kept at the first position, by aggregation
    alone, so a hot conversation is combined before the shuffle.
    """
    latest = F.max_by(F.struct("role", "text"), "seq")
    merged = (
        log.unionByName(incoming)
        .groupBy("conv_id", "msg_id")
        .agg(F.min("seq").alias("position"), latest.alias("_latest"))
    )
    return merged.select("conv_id", "msg_id", "position", "_latest.role", "_latest.text")


def prepend_system(log: DataFrame, prompt: str) -> DataFrame:
    """View of the log with a system message at turn -1 wherever none opens it."""
    first_role = log.groupBy("conv_id").agg(F.min_by("role", "turn").alias("first"))
    added = first_role.filter(F.col("first") != "system").select(
        "conv_id",
        F.lit(-1).cast("bigint").alias("turn"),
        F.lit("system").alias("role"),
        F.lit(prompt).alias("text"),
    )
    return log.select("conv_id", "turn", "role", "text").unionByName(added)


def last_answer(log: DataFrame) -> DataFrame:
    """Text of the last assistant message of every conversation."""
    turn = F.when(F.col("role") == "assistant", F.col("turn"))
    return log.groupBy("conv_id").agg(
        F.coalesce(F.max_by("text", turn), F.lit(V.NO_ANSWER_MESSAGE)).alias("answer")
    )


def history_pages(log: DataFrame, page_turns: int = PAGE_TURNS) -> DataFrame:
    """Ordered history as arrays of at most ``page_turns`` messages.

    A conversation is the concatenation of its pages; no conversation, however
    long, has to fit one task.
    """
    page = F.floor(F.col("turn") / page_turns).cast("bigint")
    return (
        log.groupBy("conv_id", page.alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    )


def clear_history(log: DataFrame, is_clear: Column) -> DataFrame:
    """Drop everything up to and including the last clear marker of a conversation."""
    marks = log.filter(is_clear).groupBy("conv_id").agg(F.max("turn").alias("_cleared"))
    return (
        log.join(marks, "conv_id", "left")
        .filter(F.col("_cleared").isNull() | (F.col("turn") > F.col("_cleared")))
        .drop("_cleared")
    )


def drop_blank(log: DataFrame, text: str = "text") -> DataFrame:
    return log.filter(trim_input(F.col(text)) != "")


def has_bot(log: DataFrame) -> DataFrame:
    return log.groupBy("conv_id").agg(F.bool_or(F.col("role") == "assistant").alias("has_bot"))
