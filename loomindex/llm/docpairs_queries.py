"""Registered queries of function-documentation pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomindex.llm.docpairs import distinct_pairs, function_doc_pairs
from loomindex.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return function_doc_pairs(table(spark, folder, "symbols")).select("symbol_id").distinct()


def p3_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_pairs(function_doc_pairs(table(spark, folder, "symbols")))


QUERIES = {"p3_found": p3_found, "p3_pairs": p3_pairs}
SQL: dict[str, str] = {}
