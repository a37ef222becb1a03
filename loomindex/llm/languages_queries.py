"""Registered queries of language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomindex.llm.languages import document_languages, meant_language
from loomindex.sources.tables import table


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return document_languages(table(spark, folder, "documents"), table(spark, folder, "lang_samples"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The languages of documents whose label is missing or wrong or that have more than one language."""
    rows = _labelled(spark, folder).filter("lang_code is not null")
    odd = rows.filter((F.size("languages") > 1) | ~meant_language(F.col("label")).eqNullSafe(F.col("lang_code")))
    return odd.select("doc_id", F.explode("languages").alias("lang_code")).distinct()


def p8_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder).select("doc_id", "lang_code", "confidence", "languages")


def p8_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Each paragraph with its language and confidence."""
    return _labelled(spark, folder).select("doc_id", F.inline("segments"))


QUERIES = {"p8_found": p8_found, "p8_documents": p8_documents, "p8_segments": p8_segments}
SQL: dict[str, str] = {}
