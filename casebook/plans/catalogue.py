"""All registered queries with their checking SQL."""

from __future__ import annotations

from casebook.plans import conversation, faq, ingest, retrieval, scores, sessions, streams

MODULES = [ingest, retrieval, conversation, faq, sessions, scores, streams]


def _all() -> dict:
    merged: dict = {}
    for module in MODULES:
        for name, pair in module.QUERIES.items():
            if name in merged:
                raise ValueError(f"query {name} is registered twice")
            merged[name] = pair
    return merged


def queries() -> dict:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
