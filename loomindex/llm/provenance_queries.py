"""Registered queries on who or what wrote a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomindex.llm.provenance import file_provenance
from loomindex.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_kinds(spark, folder).filter("kinds is not null").select("path")


def p4_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return file_provenance(table(spark, folder, "files"), table(spark, folder, "file_heads"))


QUERIES = {"p4_found": p4_found, "p4_kinds": p4_kinds}
SQL: dict[str, str] = {}
