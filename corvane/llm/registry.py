"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from corvane.llm import chat, lines, merkle, mixing, neardup_docs, neardup_vectors, packing, quality, secrets, topk, urls, warc, whitening

MODULES = (chat, secrets, neardup_vectors, packing, neardup_docs, quality, lines, urls, mixing, topk, merkle, whitening, warc)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
