"""Operators for training data; nothing outside this folder imports it."""

from __future__ import annotations

import importlib

TOPICS = ["neardup", "docpairs", "provenance", "neighbours", "packing", "mixing", "languages"]


def registered() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for topic in TOPICS:
        module = importlib.import_module(f"loomindex.llm.{topic}_queries")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
