"""Diversity re-rank of the nearest candidates, and context formatting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook import fixed_values as V
from casebook.functions.vectors import DIGITS, arrow_matrix, unit_rows


# Numbers of candidate vectors held at once by a task.
MAX_NUMBERS = 4_000_000


def _diverse_orders(queries: np.ndarray, items: np.ndarray, counts: np.ndarray, k: int, weight: float) -> np.ndarray:
    """Greedy picks, similar to the query and unlike what is already picked, for many queries at once.

    ``items`` (queries, most candidates, dim) is filled up with zeros beyond ``counts``;
    the picks are -1 beyond them.
    """
    q, m = unit_rows(queries), unit_rows(items.reshape(-1, items.shape[2])).reshape(items.shape)
    to_query = np.round(np.einsum("qnd,qd->qn", m, q), DIGITS)
    between = np.round(m @ m.transpose(0, 2, 1), DIGITS)
    open_ = np.arange(items.shape[1]) < counts[:, None]
    rows = np.arange(len(q))
    picks = np.full((len(q), k), -1)
    worst = None
    for n in range(min(k, items.shape[1])):
        score = to_query if worst is None else weight * to_query - (1 - weight) * worst
        best = np.where(open_, score, -np.inf).argmax(axis=1)
        picks[:, n] = np.where(n < counts, best, -1)
        open_[rows, best] = False
        near = between[rows, best]
        worst = near if worst is None else np.maximum(worst, near)
    return picks


def rerank(
    candidates: DataFrame,
    dim: int,
    k: int = V.FINAL_K,
    weight: float = V.DIVERSITY_LAMBDA,
    carry: list[str] | None = None,
) -> DataFrame:
    """``candidates(query_id, query_vec, item_id, rank, vec)`` to (query_id, pick, item_id).

    At most ``fetch_k`` candidates per query, so a group is small by construction.
    Ties go to the earlier candidate. Columns in ``carry`` stay with their item.
    """
    kept = ["item_id", *(carry or [])]

    @F.arrow_udf("array<int>")
    def pick(query_vecs: pa.Array, item_vecs: pa.Array) -> pa.Array:
        lengths = np.diff(item_vecs.offsets.to_numpy())
        step = max(1, MAX_NUMBERS // (dim * max(1, int(lengths.max(initial=1)))))
        out: list[pa.Array] = []
        for at in range(0, len(lengths), step):
            counts = lengths[at : at + step]
            flat = arrow_matrix(item_vecs.slice(at, step).flatten(), dim)
            items = np.zeros((len(counts), int(counts.max(initial=1)), dim))
            items[np.arange(items.shape[1]) < counts[:, None]] = flat
            picks = _diverse_orders(arrow_matrix(query_vecs.slice(at, step), dim), items, counts, k, weight)
            ends = np.cumsum((picks >= 0).sum(axis=1))
            out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(picks[picks >= 0].astype(np.int32))))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    grouped = candidates.groupBy("query_id").agg(
        F.first("query_vec").alias("query_vec"),
        F.array_sort(F.collect_list(F.struct("rank", *kept, "vec"))).alias("items"),
    )
    ordered = grouped.select(
        "query_id", "items", F.posexplode(pick("query_vec", F.col("items.vec"))).alias("at", "i")
    )
    item = F.get("items", F.col("i"))
    return ordered.select(
        "query_id", (F.col("at") + 1).cast("bigint").alias("pick"), *[item[c].alias(c) for c in kept]
    )


def context_text(ranked: Column) -> Column:
    """One text of an array of structs (rank, text) in rank order."""
    parts = F.transform(
        F.array_sort(ranked),
        lambda r: F.concat(
            F.lit(V.CONTEXT_HEADER),
            r["rank"].cast("string"),
            F.lit(V.CONTEXT_HEADER_END),
            r["text"],
            F.lit(V.CONTEXT_TAIL),
        ),
    )
    return F.array_join(parts, "")


def format_context(hits: DataFrame) -> DataFrame:
    """``hits(query_id, rank, text)``, at most ``k`` per query, to (query_id, context)."""
    ranked = F.collect_list(F.struct("rank", "text"))
    return hits.groupBy("query_id").agg(context_text(ranked).alias("context"))


def with_fallback(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """Every query with its context, or the fixed message when nothing was found."""
    return queries.join(contexts, "query_id", "left").withColumn(
        "context", F.coalesce("context", F.lit(V.NO_CONTEXT_MESSAGE))
    )
