"""Batch retrieval: a table of questions against a corpus, context per question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook import fixed_values as V
from casebook.functions.text import has_words
from casebook.functions.vectors import HASH_DIM
from casebook.operators import inverted_index
from casebook.operators.indexing import chunk_documents, embed_hashed
from casebook.operators.nearest import MAX_BROADCAST_NUMBERS, nearest
from casebook.operators.rerank import format_context, rerank, with_fallback
from casebook.operators.routing import RETRIEVE, dispatch_tool_calls, route
from casebook.session import written
from casebook.sources.collection import open_collection, write_collection


def index_chunks(documents: DataFrame, dim: int = HASH_DIM) -> DataFrame:
    """Chunks with hashed vectors; a chunk without words has no direction and is left out."""
    return embed_hashed(chunk_documents(documents).filter(has_words(F.col("text"))), dim=dim)


def _search(
    find: Callable[[DataFrame], DataFrame],
    fetch: Callable[[DataFrame], DataFrame],
    questions: DataFrame,
    dim: int,
    k: int,
    carry: tuple[str, ...] = ("text",),
) -> DataFrame:
    """First ``find`` the hits by ids and vectors only; then ``fetch`` the few rows that were hit."""
    worded = questions.filter(has_words(F.col("question")))
    asked = embed_hashed(worded, "question", dim).select("query_id", "vec")
    hits = written(find(asked), "hits")
    candidates = hits.join(fetch(hits), "item_id").join(
        asked.withColumnRenamed("vec", "query_vec"), "query_id"
    )
    return rerank(candidates, dim, k, carry=list(carry))


def search_documents(
    documents: DataFrame,
    questions: DataFrame,
    dim: int = HASH_DIM,
    fetch_k: int = V.FETCH_K,
    k: int = V.FINAL_K,
    max_numbers: int = MAX_BROADCAST_NUMBERS,
) -> DataFrame:
    """``questions(query_id, question)`` against documents: (query_id, pick, item_id, text).

    Texts and vectors of the hits come from their documents alone, which are
    selected before they are chunked, and only the hits are embedded again. Hits of more
    questions than fit one matrix are in most documents: then chunks are made and embedded
    once, and stored.
    """
    questions = written(questions, "questions")
    if questions.limit(max_numbers // dim + 1).count() > max_numbers // dim:
        chunks = written(embed_hashed(chunk_documents(documents), dim=dim).select("chunk_id", "text", "vec"), "chunks")
        stored = chunks.withColumnRenamed("chunk_id", "item_id")
        worded = stored.where(F.size("vec.idx") > 0).select("item_id", "vec")
        return _search(
            lambda asked: nearest(asked, worded, dim, fetch_k, "cosine", max_numbers, stored=True),
            lambda hits: stored.join(hits.select("item_id").distinct(), "item_id", "left_semi"),
            questions,
            dim,
            k,
        )

    def fetch(hits: DataFrame) -> DataFrame:
        wanted = hits.select(F.col("item_id").alias("chunk_id")).distinct()
        sources = wanted.select("chunk_id.doc_id").distinct()
        chunks = chunk_documents(documents.join(sources, "doc_id", "left_semi"))
        found = embed_hashed(chunks.join(wanted, "chunk_id", "left_semi"), dim=dim)
        return found.select(F.col("chunk_id").alias("item_id"), "text", "vec")

    items = index_chunks(documents, dim).select(F.col("chunk_id").alias("item_id"), "vec")
    return _search(lambda asked: nearest(asked, items, dim, fetch_k, "cosine", max_numbers), fetch, questions, dim, k)


def search_collection(
    collection: DataFrame,
    questions: DataFrame,
    dim: int = HASH_DIM,
    fetch_k: int = V.FETCH_K,
    k: int = V.FINAL_K,
    max_numbers: int = MAX_BROADCAST_NUMBERS,
    keep: Column | None = None,
    metadata: tuple[str, ...] = (),
) -> DataFrame:
    """The same against a stored collection (chunk_id, text, vec, metadata).

    ``keep`` restricts the search to some chunks by their metadata, and the columns
    named in ``metadata`` are returned with each hit.
    """
    if keep is not None:
        collection = collection.where(keep)
    carry = ("text", *metadata)
    stored = collection.select(F.col("chunk_id").alias("item_id"), *carry, "vec")

    def fetch(hits: DataFrame) -> DataFrame:
        return stored.join(hits.select("item_id").distinct(), "item_id", "left_semi")

    items = stored.select("item_id", "vec")
    return _search(lambda asked: nearest(asked, items, dim, fetch_k, "cosine", max_numbers), fetch, questions, dim, k, carry)


def index_for_search(documents: DataFrame, folder: str, dim: int = HASH_DIM) -> None:
    """Chunks as a collection with their texts, and an inverted index of their vectors."""
    chunks = index_chunks(documents, dim)
    write_collection(chunks.select("chunk_id", "text", "vec"), f"{folder}/chunks")
    stored = open_collection(documents.sparkSession, f"{folder}/chunks", ["chunk_id", "vec"])
    inverted_index.build(stored.withColumnRenamed("chunk_id", "item_id"), f"{folder}/index")


def search_indexed(
    spark: SparkSession, folder: str, questions: DataFrame, dim: int = HASH_DIM, fetch_k: int = V.FETCH_K, k: int = V.FINAL_K
) -> DataFrame:
    """``search_collection`` by the inverted index of ``index_for_search``: postings that cannot matter are not read."""
    stored = open_collection(spark, f"{folder}/chunks", ["chunk_id", "text", "vec"]).withColumnRenamed("chunk_id", "item_id")

    def fetch(hits: DataFrame) -> DataFrame:
        return stored.join(hits.select("item_id").distinct(), "item_id", "left_semi")

    return _search(lambda asked: inverted_index.search(asked, f"{folder}/index", fetch_k), fetch, questions, dim, k)


def contexts(questions: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, context) for every question, with the fallback where nothing was found."""
    hits = found.select("query_id", F.col("pick").alias("rank"), "text")
    return with_fallback(questions.select("query_id"), format_context(hits))


def ask(collection: DataFrame, question: str, dim: int = HASH_DIM) -> DataFrame:
    """Context of a single question: the batch form with a table of one row."""
    spark = collection.sparkSession
    asked = spark.createDataFrame([(0, question)], "query_id bigint, question string")
    return contexts(asked, search_collection(collection, asked, dim)).select("context")


def tool_messages(log: DataFrame, documents: DataFrame, rules, dim: int = HASH_DIM) -> DataFrame:
    """Route the user messages of a log, retrieve for those that need it, and return
    the tool messages to append: (conv_id, turn, call_no, tool_call_id, name, content).

    A text asked many times is retrieved once.
    """
    calls = log.filter(
        (F.col("role") == "user") & (route(F.col("text"), rules) == RETRIEVE)
    ).select("conv_id", "turn", "text")
    # A question goes by the first message that asked it.
    asked = calls.groupBy(F.col("text").alias("question")).agg(F.min(F.struct("conv_id", "turn")).alias("query_id"))
    answers = contexts(asked, search_documents(documents, asked, dim))
    results = asked.join(answers, "query_id").select(
        F.col("question").alias("query"), F.col("context").alias("result")
    )
    call = F.struct(
        F.lit(V.RETRIEVAL_TOOL).alias("name"),
        F.create_map(F.lit("query"), F.col("text")).alias("args"),
        F.concat_ws("-", F.lit("call"), "conv_id", "turn").alias("id"),
    )
    return dispatch_tool_calls(
        calls.select("conv_id", "turn", F.array(call).alias("tool_calls")), results
    )
