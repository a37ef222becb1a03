"""Registered queries by topic; each module has QUERIES and SQL."""

from __future__ import annotations

import importlib

TOPICS = ["text_queries", "search_queries", "graph_queries", "change_queries", "extract_queries", "orphan_queries"]


def registered() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for topic in TOPICS:
        module = importlib.import_module(f"loomindex.queries.{topic}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
