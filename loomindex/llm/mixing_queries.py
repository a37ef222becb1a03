"""Registered queries of mixing sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomindex.llm.mixing import Mix
from loomindex.llm.tokens import token_sizes
from loomindex.session import materialize
from loomindex.sources.tables import table


def _mix(spark: SparkSession, folder: str) -> Mix:
    sizes = materialize(token_sizes(table(spark, folder, "documents")), "sizes")
    return Mix(sizes, table(spark, folder, "mix_targets"))


def p7_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).shuffled()


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).report()


QUERIES = {"p7_mixed": p7_mixed, "p7_shares": p7_shares}
SQL: dict[str, str] = {}
