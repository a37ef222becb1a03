"""Readers of the index tables and the schemas they are expected to have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the index tables, as DDL.
SYMBOLS = (
    "id bigint, path string, language string, kind string, name string, signature string, body string, doc string,"
    " fallback boolean, start_line int, start_column int, end_line int, end_column int"
)
FILES = "path string, language string, size bigint, mtime_ms double"
RELATIONS = "id bigint, source_symbol_id bigint, source_path string, relation_kind string, target_path string, target_label string"
EMBEDDINGS = "symbol_id bigint, provider string, model string, dimensions int, embedding array<double>"


def column_names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(df: DataFrame, *keys: str) -> DataFrame:
    """Rows delivered twice count once: one row per key.

    An aggregate per column, so that columns that a query does not use are pruned down to the scan.
    Map-side aggregation merges repeated rows before the exchange, so a row delivered many times
    makes no hot task. (Rows of one key are the same row; were they not, each column would take its least value.)
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in rest]) if rest else df.distinct()


def symbols(spark: SparkSession, folder: str) -> DataFrame:
    """One row per symbol id."""
    columns = column_names(SYMBOLS)
    return once(table(spark, folder, "symbols").select(*columns).filter("id is not null"), "id")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The newest state of every path (largest mtime, then size)."""
    rows = table(spark, folder, "files").select("path", "language", "size", "mtime_ms").filter("path is not null")
    newest = F.max(F.struct("mtime_ms", "size", "language")).alias("_row")
    return rows.groupBy("path").agg(newest).select("path", "_row.language", "_row.size", "_row.mtime_ms")


def relations(spark: SparkSession, folder: str) -> DataFrame:
    """One row per relation id."""
    columns = column_names(RELATIONS)
    return once(table(spark, folder, "relations").select(*columns).filter("id is not null"), "id")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct vectors of symbols; vectors that cannot be compared are kept for the caller to judge."""
    columns = column_names(EMBEDDINGS)
    return table(spark, folder, "symbol_embeddings").select(*columns).distinct()
