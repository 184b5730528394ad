"""Registered queries: FAQ answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook import fixed_values as V
from casebook.functions.labels import blended_text, illustration as illustrate, tone_label as label
from casebook.operators.faq import answer_requests, match_faq
from casebook.operators.keywords import match_keywords
from casebook.plans import inputs
from casebook.plans import sql as S
from casebook.sources.requests import decode_requests, mark_rejects


def _requests(spark, folder):
    return decode_requests(inputs.request_payloads(spark, folder))


def faq_match(spark, folder):
    matched = match_faq(inputs.documents(spark, folder), inputs.FAQ, inputs.FAQ_DEFAULT, "text")
    return matched.select("doc_id", F.col("faq_no").cast("bigint").alias("faq_no"), "keyword")


def keyword_table(spark, folder):
    """Words of four letters and more, and pairs of neighbouring words, of the benchmark, placed by item and position."""
    words = inputs.table(spark, folder, "benchmark").select("item_id", F.split(F.lower("text"), " ").alias("w"))
    each = words.select("item_id", "w", F.posexplode("w").alias("i", "word"))
    place = F.col("item_id") * 100000 + F.col("i") * 2
    pair = F.concat_ws(" ", "word", F.get("w", F.col("i") + 1))
    singles = each.where(F.length("word") >= 4).select(place.alias("place"), F.col("word").alias("keyword"))
    return singles.unionByName(each.where(F.col("i") + 1 < F.size("w")).select((place + 1).alias("place"), pair.alias("keyword")))


def faq_match_many(spark, folder):
    """Every document against the benchmark's keywords: how many it contains, and the first declared one (-1, null: none)."""
    matched = match_keywords(inputs.documents(spark, folder), keyword_table(spark, folder), "text")
    first = F.get("found", F.lit(0))
    return matched.select(
        "doc_id", F.size("found").cast("bigint").alias("keywords"), F.coalesce(first["place"], F.lit(-1)).alias("faq_no"), first["keyword"].alias("keyword")
    )


def tone_blend(spark, folder):
    text = blended_text(F.col("character"), F.col("tone"), F.lit("L"), F.lit("N"))
    return _requests(spark, folder).select("doc_id", "character", "tone", text.alias("text"))


def _flat(column: str):
    return [F.col(f"{column}.{f}").alias(f"picture_{f}") for f in ("type", "url", "caption")]


def illustration(spark, folder):
    made = _requests(spark, folder).withColumn(
        "picture",
        illustrate(
            F.col("illustration"),
            F.when(F.col("character") == "lawyer", "lc"),
            F.concat(F.lit("poster-"), F.col("character")),
        ),
    )
    return made.select("doc_id", *_flat("picture"))


def tone_label(spark, folder):
    return (
        _requests(spark, folder)
        .groupBy(label(F.col("tone")).alias("label"))
        .agg(F.count("*").alias("requests"))
    )


def faq_answer(spark, folder):
    valid = mark_rejects(_requests(spark, folder)).filter("valid")
    asked = valid.select("doc_id", "question", "character", "tone", "illustration")
    at = F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    answers = answer_requests(asked, inputs.FAQ, inputs.FAQ_DEFAULT, at)
    return answers.select("doc_id", "text", "character", "timestamp", *_flat("illustration"))


_PLAIN, _BALANCED = S.quote(V.TONE_PREFIX_PLAIN), S.quote(V.TONE_PREFIX_BALANCED)


def _blend(lawyer: str, normal: str) -> str:
    return f"""CASE WHEN character = 'lawyer' THEN
        CASE WHEN tone > 50 THEN {lawyer} WHEN tone < 30 THEN {normal}
             WHEN tone < 50 THEN {_PLAIN} || {normal} ELSE {_BALANCED} || {lawyer} END
      ELSE CASE WHEN tone < 50 THEN {normal} WHEN tone > 70 THEN {lawyer}
             ELSE {_BALANCED} || {lawyer} END END"""


def _picture(kind: str, url: str) -> str:
    return f"""CASE WHEN {url} IS NOT NULL THEN {kind} END AS picture_type, {url} AS picture_url,
      CASE WHEN {url} IS NULL THEN NULL WHEN {kind} = 'comic' THEN {S.quote(V.CAPTION_COMIC)}
           ELSE {S.quote(V.CAPTION_POSTER)} END AS picture_caption"""


QUERIES = {
    "faq_match": (
        faq_match,
        f"""WITH {S.DOCS}, {S.FAQ_TABLE}
            SELECT doc_id, faq_no::BIGINT AS faq_no, keyword
            FROM (SELECT doc_id, {S.faq_position('text')} AS faq_no FROM docs) JOIN faq USING (faq_no)""",
    ),
    "faq_match_many": (
        faq_match_many,
        f"""WITH {S.DOCS},
            w AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark),
            e AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
            k AS (SELECT keyword, min(place) AS place FROM (
                    SELECT item_id * 100000 + (i - 1) * 2 AS place, w[i] AS keyword FROM e WHERE length(w[i]) >= 4
                    UNION ALL SELECT item_id * 100000 + (i - 1) * 2 + 1, w[i] || ' ' || w[i + 1] FROM e WHERE i < len(w))
                  GROUP BY keyword),
            m AS (SELECT d.doc_id, count(*) AS keywords, min(place) AS faq_no, arg_min(keyword, place) AS keyword
                  FROM (SELECT doc_id, lower(text) AS low FROM docs) d JOIN k ON contains(d.low, k.keyword) GROUP BY 1)
            SELECT doc_id, coalesce(keywords, 0)::BIGINT AS keywords, coalesce(faq_no, -1)::BIGINT AS faq_no, keyword
            FROM docs LEFT JOIN m USING (doc_id)""",
    ),
    "tone_blend": (
        tone_blend,
        f"WITH {S.REQUESTS} SELECT doc_id, character, tone, {_blend(chr(39) + 'L' + chr(39), chr(39) + 'N' + chr(39))} AS text FROM requests",
    ),
    "illustration": (
        illustration,
        f"""WITH {S.REQUESTS}
            SELECT doc_id, {_picture('illustration', 'url')} FROM (
              SELECT *, CASE illustration WHEN 'comic' THEN CASE WHEN character = 'lawyer' THEN 'lc' END
                        WHEN 'poster' THEN 'poster-' || character END AS url FROM requests)""",
    ),
    "tone_label": (
        tone_label,
        f"""WITH {S.REQUESTS}
            SELECT CASE WHEN tone < 30 THEN '{V.TONE_LABEL_CASUAL}' WHEN tone > 70 THEN '{V.TONE_LABEL_LEGAL}'
                   ELSE '{V.TONE_LABEL_BALANCED}' END AS label, count(*) AS requests
            FROM requests GROUP BY 1""",
    ),
    "faq_answer": (
        faq_answer,
        f"""WITH {S.REQUESTS}, {S.FAQ_TABLE},
            m AS (SELECT *, {S.faq_position('question')} AS faq_no FROM requests WHERE question <> ''),
            j AS (SELECT *, CASE illustration
                     WHEN 'comic' THEN CASE WHEN character = 'lawyer' THEN lc ELSE nc END
                     WHEN 'poster' THEN CASE WHEN character = 'lawyer' THEN lp ELSE np END END AS url
                  FROM m JOIN faq USING (faq_no))
            SELECT doc_id, {_blend('lt', 'nt')} AS text, character, TIMESTAMP '2024-01-01 00:00:00' AS timestamp,
              {_picture('illustration', 'url')} FROM j""",
    ),
}
