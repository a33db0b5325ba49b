"""All queries of the library but those of the training-data operators."""

from __future__ import annotations

from corvane.plans import corpus_queries, label_queries, metric_queries, text_queries

MODULES = (text_queries, corpus_queries, metric_queries, label_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
