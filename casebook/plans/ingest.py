"""Registered queries: sources, chunking, embedding, indexing."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions.vectors import DIGITS
from casebook.operators.indexing import chunk_documents, embed_hashed, vector_entries
from casebook.plans import inputs
from casebook.plans import sql as S
from casebook.session import fresh_path
from casebook.sources.collection import missing_chunks, open_collection, write_collection
from casebook.sources.replacing import index_documents, open_replacing
from casebook.sources.requests import decode_requests, mark_rejects
from casebook.sources.source_map import explode_map, explode_variant


def load_documents(spark, folder):
    return inputs.documents(spark, folder)


def json_map_explode(spark, folder):
    maps = inputs.events(spark, folder).select(
        F.col("user_id"), F.array(F.from_json("props", "map<string,int>")).alias("maps")
    )
    return explode_map(maps, ["user_id"], "maps", "title", "number").select(
        "user_id", "title", F.col("number").cast("bigint").alias("number")
    )


# A payload of mixed types whose first key is data; the same text in Spark and DuckDB.
PAYLOAD = """concat('{"', event_type, '":', replace(props, ' ', ''), ',"user":"u', user_id, '","even":', user_id % 2 = 0,
                ',"parts":[', user_id, ',"', event_id % 3, '"],"none":null}')"""


def json_variant_explode(spark, folder):
    payloads = inputs.events(spark, folder).select("user_id", F.expr(PAYLOAD).alias("payload"))
    return explode_variant(payloads, ["user_id"], "payload")


def chunk_recursive(spark, folder):
    return chunk_documents(inputs.documents(spark, folder)).drop("n_chars", "chunk_id")


def chunk_fixed(spark, folder):
    return chunk_documents(inputs.documents(spark, folder), "fixed").select(
        "doc_id", "chunk_no", "text"
    )


def embed_hash(spark, folder):
    chunks = embed_hashed(chunk_documents(inputs.documents(spark, folder)).select("chunk_id", "text"))
    entries = vector_entries(chunks, ["chunk_id"])
    return entries.select("chunk_id.doc_id", "chunk_id.chunk_no", "bucket", F.round("weight", DIGITS).alias("weight"))


def index_incremental(spark, folder):
    """Index the English documents, then offer all documents: only new chunks come through."""
    docs = inputs.documents(spark, folder)
    target = fresh_path(spark, "collection")
    write_collection(chunk_documents(docs.filter(F.col("lang") == "en")), target)
    new = missing_chunks(chunk_documents(docs), open_collection(spark, target, ["chunk_id"]))
    return new.select("doc_id", "page", "chunk_no", "text", "lang")


def index_changed(spark, folder):
    """Index all documents, then a later state of the source: odd ones revised, every seventh gone."""
    docs = inputs.documents(spark, folder)
    target = fresh_path(spark, "replacing")
    index_documents(docs, target)
    revised = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("Revised. "), "text")).otherwise(F.col("text"))
    index_documents(docs.withColumn("text", revised).where("doc_id % 7 <> 0"), target)
    return open_replacing(spark, target).select("doc_id", "page", "chunk_no", "text", "lang", "run")


def request_defaults(spark, folder):
    return decode_requests(inputs.request_payloads(spark, folder))


def reject_split(spark, folder):
    marked = mark_rejects(decode_requests(inputs.request_payloads(spark, folder)))
    return marked.select(
        "doc_id", "valid", F.col("status").cast("bigint").alias("status"), "code", "details"
    )


REVISED = S.DOCS.replace("SELECT *", "SELECT * REPLACE (CASE WHEN doc_id % 2 = 1 THEN 'Revised. ' || text ELSE text END AS text)")

QUERIES = {
    "index_changed": (
        index_changed,
        f"""WITH RECURSIVE {S.CHUNKS.replace(S.DOCS, REVISED + " ", 1)}
            SELECT doc_id, page, chunk_no, text, lang, CASE WHEN doc_id % 2 = 1 THEN 2 ELSE 1 END::BIGINT AS run
            FROM chunks WHERE doc_id % 7 <> 0""",
    ),
    "load_documents": (load_documents, f"WITH {S.DOCS} SELECT *, 0::BIGINT AS page FROM docs"),
    "json_map_explode": (
        json_map_explode,
        f"""SELECT DISTINCT user_id, e.key AS title, (e.value::VARCHAR)::BIGINT AS number
            FROM events, json_each(props::JSON) e""",
    ),
    "json_variant_explode": (
        json_variant_explode,
        f"""SELECT DISTINCT user_id, e.key,
              CASE e.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string'
                WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
              CASE WHEN e.type <> 'NULL' THEN e.value ->> '$' END AS value
            FROM (SELECT user_id, {PAYLOAD} AS payload FROM events) p, json_each(payload::JSON) e""",
    ),
    "chunk_recursive": (chunk_recursive, f"WITH RECURSIVE {S.CHUNKS} SELECT * EXCLUDE (chunk_id) FROM chunks"),
    "chunk_fixed": (
        chunk_fixed,
        f"""WITH {S.DOCS}, w AS (
              SELECT doc_id, text, unnest(range(0, 1 + greatest(0, ceil((length(text) - 1000) / 800.0))::BIGINT)) AS i
              FROM docs),
            c AS (SELECT doc_id, i, trim(substr(text, i * 800 + 1, 1000), {S.STRIP}) AS text FROM w)
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_no, text
            FROM c WHERE text <> ''""",
    ),
    "embed_hash": (
        embed_hash,
        f"""WITH RECURSIVE {S.CHUNKS}, {S.entries('chunk_entries', 'chunks', 'chunk_id')}
            SELECT chunk_id.doc_id AS doc_id, chunk_id.chunk_no AS chunk_no, bucket, round(weight, 6) AS weight FROM chunk_entries""",
    ),
    "index_incremental": (
        index_incremental,
        f"""WITH RECURSIVE {S.CHUNKS}
            SELECT doc_id, page, chunk_no, text, lang FROM chunks WHERE lang <> 'en'""",
    ),
    "request_defaults": (request_defaults, f"WITH {S.REQUESTS} SELECT * FROM requests"),
    "reject_split": (
        reject_split,
        f"""WITH {S.REQUESTS}
            SELECT doc_id, coalesce(question, '') <> '' AS valid,
              CASE WHEN coalesce(question, '') = '' THEN 400::BIGINT ELSE 200 END AS status,
              CASE WHEN coalesce(question, '') = '' THEN 'BAD_REQUEST' END AS code,
              CASE WHEN coalesce(question, '') = '' THEN 'The ''question'' field is required' END AS details
            FROM requests""",
    ),
}
