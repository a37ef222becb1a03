"""Registered queries of container filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomindex.llm.packing import pack, pack_report
from loomindex.llm.tokens import token_sizes
from loomindex.sources.tables import table


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack(token_sizes(table(spark, folder, "documents")), table(spark, folder, "pack_limits"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return pack_report(p6_packed(spark, folder))


QUERIES = {"p6_packed": p6_packed, "p6_report": p6_report}
SQL: dict[str, str] = {}
