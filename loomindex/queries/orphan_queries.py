"""Registered queries of the orphan-reference operator, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomindex.operators.orphans import orphan_references, orphan_report
from loomindex.sources.tables import table


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_references(*(table(spark, folder, t) for t in ("relations", "symbols", "files", "file_changes")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("relation_id", "ref_field").distinct()


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(_orphans(spark, folder))


def canonical_sql(column: str) -> str:
    """Same spelling rules in SQL: up to eight ``..`` steps are resolved, one per pass."""
    sql = f"'/' || regexp_replace(replace(trim({column}, chr(32) || chr(9) || chr(10) || chr(13)), '\\', '/'), '/+', '/', 'g') || '/'"
    for _ in range(3):
        sql = f"replace({sql}, '/./', '/')"
    sql = f"regexp_replace({sql}, '/+', '/', 'g')"
    for _ in range(8):
        sql = f"regexp_replace({sql}, '/([^/.]|[.][^/.]|[.][.][^/]|[^/.][^/])[^/]*/[.][.]/', '/')"
    return f"trim({sql}, '/')"


_CASES = f"""
WITH rel AS (
  SELECT DISTINCT id AS relation_id, coalesce(strftime(indexed_at, '%Y-%m'), 'unknown') AS period,
         source_symbol_id, source_path, target_path FROM relations
), newest AS (
  SELECT {canonical_sql('path')} AS path, arg_max(change_kind, (seen_at, change_id)) AS kind FROM file_changes GROUP BY 1
), present AS (
  SELECT DISTINCT f.path FROM files f LEFT JOIN newest n USING (path) WHERE n.kind IS NULL OR n.kind <> 'deleted'
), refs AS (
  SELECT relation_id, period, 'source_path' AS ref_field, source_path AS key FROM rel
  UNION ALL SELECT relation_id, period, 'target_path', target_path FROM rel
), cases AS (
  SELECT relation_id, 'source_symbol_id' AS ref_field, period FROM rel
  WHERE source_symbol_id IS NOT NULL AND source_symbol_id NOT IN (SELECT id FROM symbols WHERE id IS NOT NULL)
  UNION
  SELECT relation_id, ref_field, period FROM refs
  WHERE key IS NOT NULL AND trim(key) <> '' AND {canonical_sql('key')} NOT IN (SELECT path FROM present WHERE path IS NOT NULL)
)
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
SQL = {
    "p2_found": _CASES + "SELECT DISTINCT relation_id, ref_field FROM cases",
    "p2_report": _CASES
    + "SELECT CASE WHEN ref_field = 'source_symbol_id' THEN 'symbols' ELSE 'files' END AS referenced_table,"
    + " ref_field, period, count(*) AS orphans FROM cases GROUP BY ALL",
}
