"""Small tables with the index schemas; every helper fills what a test leaves out."""

from __future__ import annotations

import datetime as dt

SYMBOL = "id bigint, path string, language string, kind string, name string, signature string, body string, doc string, fallback boolean, start_line int, start_column int, end_line int, end_column int"
RELATION = "id bigint, source_symbol_id bigint, source_path string, relation_kind string, target_path string, target_label string, indexed_at timestamp_ntz"
AT = dt.datetime(2025, 3, 4, 5, 6)


def symbols(spark, rows: list[dict]):
    base = {"path": "src/a.py", "language": "python", "kind": "function", "name": "f", "signature": None, "body": "", "doc": None, "fallback": False, "start_line": 1, "start_column": 1, "end_line": 2, "end_column": 1}
    names = [c.split()[0] for c in SYMBOL.split(", ")]
    return spark.createDataFrame([tuple(({"id": i + 1} | base | r)[c] for c in names) for i, r in enumerate(rows)], SYMBOL)


def relations(spark, rows: list[dict]):
    base = {"source_symbol_id": None, "source_path": "src/a.py", "relation_kind": "uses", "target_path": None, "target_label": "x", "indexed_at": AT}
    names = [c.split()[0] for c in RELATION.split(", ")]
    return spark.createDataFrame([tuple(({"id": i + 1} | base | r)[c] for c in names) for i, r in enumerate(rows)], RELATION)


def files(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, "path string, language string, size bigint, mtime_ms double")


def changes(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, "change_id bigint, path string, change_kind string, seen_at timestamp_ntz")


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
