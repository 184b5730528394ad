"""The registered queries of this package and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casebook.llm import decontaminate, html_text, language, line_bitmaps, near_duplicates, neighbour_graph, ngram_scores, periodic_runs, pieces, quality, secrets, token_alignment, token_counts

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_sentencepiece": (pieces.query, None),
    "op2_ngram_scores": (ngram_scores.query, ngram_scores.SQL),
    "op3_language": (language.query, None),
    "op4_secrets": (secrets.query, secrets.SQL),
    "op5_near_duplicates": (near_duplicates.query, near_duplicates.SQL),
    "op6_html_text": (html_text.query, None),
    "op7_quality": (quality.query, None),
    "op8_decontamination": (decontaminate.query, decontaminate.SQL),
    "op9_token_counts": (token_counts.query, None),
    "op10_neighbour_graph": (neighbour_graph.query, None),
    "op11_periodic_runs": (periodic_runs.query, None),
    "op12_line_bitmaps": (line_bitmaps.query, line_bitmaps.SQL),
    "op13_token_alignment": (token_alignment.query, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
