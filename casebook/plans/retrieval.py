"""Registered queries: nearest neighbours, re-rank, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.fixed_values import NO_CONTEXT_MESSAGE
from casebook.functions.vectors import DIGITS
from casebook.operators import cell_index
from casebook.operators.nearest import nearest
from casebook.operators.rerank import format_context, rerank, with_fallback
from casebook.plans import inputs
from casebook.plans import sql as S
from casebook.plans.answering import (
    contexts,
    index_chunks,
    index_for_search,
    search_collection,
    search_documents,
    search_indexed,
    tool_messages,
)
from casebook.session import fresh_path
from casebook.sources.collection import open_collection, write_collection


def knn_topk(spark, folder):
    queries, items = inputs.vectors(spark, folder)
    return nearest(queries, items, inputs.VECTOR_DIM)


# Queries in a tile where a query shows the form for large query tables.
TILE = 200


def knn_cells(spark, folder):
    """The form for query tables too large for one matrix: one scan per tile of queries."""
    queries, items = inputs.vectors(spark, folder)
    return nearest(queries, items, inputs.VECTOR_DIM, max_numbers=TILE * inputs.VECTOR_DIM)


def _stored_cells(spark, folder):
    queries, items = inputs.vectors(spark, folder)
    target = fresh_path(spark, "cells")
    cell_index.build(items, target, inputs.VECTOR_DIM)
    return queries, target


def knn_indexed(spark, folder):
    """Store the collection by cells, then read for each query only the cells that matter to it."""
    queries, target = _stored_cells(spark, folder)
    return cell_index.search(queries, target, inputs.VECTOR_DIM)


def ann_probed(spark, folder):
    """Approximate, the number of cells measured first and then given: ids and ranks as from `ann_calibrated`."""
    queries, target = _stored_cells(spark, folder)
    probes = cell_index.enough_probes(queries, target, inputs.VECTOR_DIM)
    return cell_index.probe(queries, target, inputs.VECTOR_DIM, probes=probes)


def ann_calibrated(spark, folder):
    """Approximate: each query looks into as many nearest cells as a recall of 0.9 takes."""
    queries, target = _stored_cells(spark, folder)
    return cell_index.probe(queries, target, inputs.VECTOR_DIM)


def mmr_rerank(spark, folder):
    queries, items = inputs.vectors(spark, folder)
    candidates = (
        nearest(queries, items, inputs.VECTOR_DIM)
        .join(items, "item_id")
        .join(queries.withColumnRenamed("vec", "query_vec"), "query_id")
    )
    return rerank(candidates, inputs.VECTOR_DIM)


def _contexts(spark, folder):
    texts = inputs.documents(spark, folder).select(F.col("doc_id").alias("item_id"), "text")
    hits = mmr_rerank(spark, folder).withColumnRenamed("pick", "rank")
    return format_context(hits.join(texts, "item_id"))


def format_contexts(spark, folder):
    return _contexts(spark, folder)


def context_fallback(spark, folder):
    asked = inputs.documents(spark, folder).select(F.col("doc_id").alias("query_id"))
    return with_fallback(asked, _contexts(spark, folder))


def _questions(spark, folder):
    return inputs.table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )


def rag_batch(spark, folder):
    questions = _questions(spark, folder)
    return contexts(questions, search_documents(inputs.documents(spark, folder), questions))


def rag_collection(spark, folder):
    """Index once into a stored collection, then ask it."""
    target = fresh_path(spark, "index")
    chunks = index_chunks(inputs.documents(spark, folder))
    write_collection(chunks.select("chunk_id", "text", "lang", "source", "vec"), target)
    stored = open_collection(spark, target, ["chunk_id", "text", "vec"])
    questions = _questions(spark, folder)
    return contexts(questions, search_collection(stored, questions))


def rag_indexed(spark, folder):
    """Index by inverted lists, then ask: only blocks of postings that can matter are read."""
    target = fresh_path(spark, "inverted")
    index_for_search(inputs.documents(spark, folder), target)
    questions = _questions(spark, folder)
    return contexts(questions, search_indexed(spark, target, questions))


def chat_retrieval(spark, folder):
    return tool_messages(
        inputs.conversations(spark, folder), inputs.documents(spark, folder), inputs.ROUTE_RULES
    )


def ann_recall(spark, folder):
    """Share of the exact neighbours that probing finds, per query."""
    exact = knn_topk(spark, folder).select("query_id", "item_id")
    hit = ann_probed(spark, folder).select("query_id", "item_id").withColumn("hit", F.lit(1))
    return (
        exact.join(hit, ["query_id", "item_id"], "left")
        .groupBy("query_id")
        .agg(F.round(F.count("hit") / F.count("*"), DIGITS).alias("recall"))
    )


_TOPK = f"WITH {S.DENSE_HITS} SELECT query_id, item_id, rank, distance FROM hits"
_CALIBRATED = f"WITH {S.DENSE_HITS}, {S.CALIBRATED} SELECT query_id, item_id, rank, distance FROM calibrated"
_DENSE_PICKS = f"{S.DENSE_HITS}, {S.DENSE_PAIRS}, {S.picks('hits')}"


def _context(picked: str, texts: str, key: str) -> str:
    return f"""
ctx AS (SELECT p.query_id,
          string_agg('--- Tài liệu ' || p.pick || ' ---' || chr(10) || t.text || chr(10) || chr(10), ''
                     ORDER BY p.pick) AS context
        FROM {picked} p JOIN {texts} t ON t.{key} = p.item_id GROUP BY 1)"""


_MESSAGE = S.quote(NO_CONTEXT_MESSAGE)


def _answers(questions: str) -> str:
    """CTEs up to ctx(query_id, context) for ``asked(query_id, question)``."""
    return f"""WITH RECURSIVE {S.CHUNKS}, {questions},
{S.entries('chunk_entries', 'chunks', 'chunk_id')}, {S.entries('question_entries', 'asked', 'query_id', 'question')},
{S.sparse_hits('hits', 'question_entries')}, {S.sparse_pairs('hits')}, {S.picks('hits')},
{_context('picked5', 'chunks', 'chunk_id')}"""


_RAG = f"""{_answers('asked AS (SELECT item_id AS query_id, text AS question FROM benchmark)')}
SELECT a.query_id, coalesce(context, {_MESSAGE}) AS context
FROM asked a LEFT JOIN ctx USING (query_id)"""

QUERIES = {
    "knn_topk": (knn_topk, _TOPK),
    "knn_cells": (knn_cells, _TOPK),
    "knn_indexed": (knn_indexed, _TOPK),
    "ann_probed": (ann_probed, _CALIBRATED),
    "ann_calibrated": (ann_calibrated, _CALIBRATED),
    "ann_recall": (
        ann_recall,
        f"""WITH {S.DENSE_HITS}, {S.CALIBRATED}
            SELECT h.query_id, round(count(p.item_id) / count(*), 6) AS recall
            FROM hits h LEFT JOIN calibrated p ON p.query_id = h.query_id AND p.item_id = h.item_id GROUP BY 1""",
    ),
    "mmr_rerank": (mmr_rerank, f"WITH {_DENSE_PICKS} SELECT * FROM picked5"),
    "format_context": (
        format_contexts,
        f"WITH {S.DOCS}, {_DENSE_PICKS}, {_context('picked5', 'docs', 'doc_id')} SELECT * FROM ctx",
    ),
    "context_fallback": (
        context_fallback,
        f"""WITH {S.DOCS}, {_DENSE_PICKS}, {_context('picked5', 'docs', 'doc_id')}
            SELECT d.doc_id AS query_id, coalesce(context, {_MESSAGE}) AS context
            FROM docs d LEFT JOIN ctx ON ctx.query_id = d.doc_id""",
    ),
    "rag_batch": (rag_batch, _RAG),
    "rag_collection": (rag_collection, _RAG),
    "rag_indexed": (rag_indexed, _RAG),
    "chat_retrieval": (
        chat_retrieval,
        f"""{_answers(f'''calls AS (SELECT * FROM conversations WHERE role = 'user' AND {S.route_case('text')} = 'retrieve'),
asked AS (SELECT text AS question, min(struct_pack(conv_id := conv_id, turn := turn)) AS query_id FROM calls GROUP BY 1)''')}
            SELECT c.conv_id, c.turn, 0::BIGINT AS call_no, 'call-' || c.conv_id || '-' || c.turn AS tool_call_id,
                   'rag_retrieval' AS name, coalesce(context, {_MESSAGE}) AS content
            FROM calls c JOIN asked a ON a.question = c.text LEFT JOIN ctx USING (query_id)""",
    ),
}
