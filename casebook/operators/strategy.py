"""Argument edits and evidence links of a session's strategy."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.session import written

FIRST_ARGUMENT = 1


def _fold_prefix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits sorted by session and order; holds one session's live arguments at a time."""
    columns = ["session_id", "arg_id", "offset_s", "event_id", "dropped"]
    session, live = None, []
    for batch in batches:
        done = []
        for row in batch.itertuples(index=False):
            if row.session_id != session:
                done += live
                session, live = row.session_id, []
            if row.op == "add":
                live.append((session, row.arg_id, row.offset_s, row.event_id, row.dropped))
            elif len(live) > 1:
                live = [item for item in live if item[1] != row.arg_id]
        yield pd.DataFrame(done, columns=columns)
    yield pd.DataFrame(live, columns=columns)


def live_arguments(edits: DataFrame, sessions: DataFrame) -> DataFrame:
    """Arguments of each session after all edits, in list order.

    ``edits(session_id, offset_s, event_id, op, arg_id, text)`` with op add, replace
    or remove; ``sessions(session_id)``. A session starts with one empty
    argument. A removal does nothing while a single argument is left.

    That guard depends on the current list, but only until an argument arrives
    that no later edit removes: from then on the list is never empty, and every
    removal of another argument counts. So the ordered fold is needed only for
    the edits before that moment, and everything after it is an aggregation.
    """
    at = F.struct("offset_s", "event_id")
    ids = ["session_id", "arg_id"]
    keys = [*ids, "offset_s", "event_id"]
    first = sessions.select(
        "session_id",
        F.lit(FIRST_ARGUMENT).cast("bigint").alias("arg_id"),
        F.lit(-1).cast("bigint").alias("offset_s"),
        F.lit(-1).cast("bigint").alias("event_id"),
    )
    removes = edits.filter(F.col("op") == "remove").select(*keys)
    last_removal = removes.groupBy(*ids).agg(F.max(at).alias("removed_at"))
    added = edits.filter(F.col("op") == "add").select(*keys).unionByName(first)
    lasting = F.col("removed_at").isNull() | (F.col("removed_at") < at)
    adds = written(
        added.join(last_removal, ids, "left").withColumn("lasting", lasting), "arguments"
    )

    settled = adds.filter("lasting").groupBy("session_id").agg(F.min(at).alias("settled_at"))
    before = F.col("settled_at").isNull() | (at < F.col("settled_at"))
    dated = adds.join(settled, "session_id", "left")
    dropped = F.coalesce(F.col("removed_at") > F.col("settled_at"), F.lit(False))
    early = (
        dated.filter(before)
        .select(*keys, F.lit("add").alias("op"), dropped.alias("dropped"))
        .unionByName(
            removes.join(settled, "session_id", "left")
            .filter(before)
            .select(*keys, F.lit("remove").alias("op"), F.lit(False).alias("dropped"))
        )
    )
    # By a hash of its own: Spark leaves out a repartition by the key that the joins below have
    # dealt by, and may then change these joins, after which a session lies in several tasks.
    survivors = (
        early.repartition(F.xxhash64("session_id"))
        .sortWithinPartitions("session_id", "offset_s", "event_id")
        .mapInPandas(
            _fold_prefix,
            "session_id bigint, arg_id bigint, offset_s bigint, event_id bigint, dropped boolean",
        )
        .filter(~F.col("dropped"))
    )
    later = dated.filter(F.col("lasting") & ~before)
    texts = (
        edits.filter(F.col("op") == "replace")
        .groupBy(*ids)
        .agg(F.max_by(F.struct("text", at.alias("at")), at).alias("last"))
    )
    return (
        survivors.select(*keys)
        .unionByName(later.select(*keys))
        .join(texts, ids, "left")
        .select(
            "session_id",
            "arg_id",
            F.col("offset_s").alias("added_s"),
            F.col("event_id").alias("added_by"),
            F.coalesce(F.when(F.col("last.at") > at, F.col("last.text")), F.lit("")).alias("text"),
        )
    )


def linked_evidence(toggles: DataFrame) -> DataFrame:
    """Links present after all toggles: those toggled an odd number of times."""
    keys = ["session_id", "evidence_id", "argument_id"]
    return (
        toggles.groupBy(*keys)
        .agg(F.count("*").alias("toggles"))
        .filter(F.col("toggles") % 2 == 1)
        .select(*keys)
    )


def dangling_links(links: DataFrame, arguments: DataFrame) -> DataFrame:
    """Links whose argument is no longer in the list."""
    live = arguments.select("session_id", F.col("arg_id").alias("argument_id")).distinct()
    return links.join(live, ["session_id", "argument_id"], "left_anti")
