"""Registered queries of the nearest-neighbour search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomindex.llm.neighbours import Neighbours
from loomindex.sources.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs with a cosine of 0.85 or more in which one is among the five best of the other."""
    best = Neighbours(table(spark, folder, "symbol_embeddings"), k=5, floor=0.85).search()
    return best.select(F.least("query_id", "id").alias("symbol_a"), F.greatest("query_id", "id").alias("symbol_b")).distinct()


def p5_top(spark: SparkSession, folder: str) -> DataFrame:
    """The five best of every vector whose id is divisible by 100, against all vectors, without a floor."""
    return Neighbours(table(spark, folder, "symbol_embeddings"), k=5).search(F.col("id") % 100 == 0)


QUERIES = {"p5_found": p5_found, "p5_top": p5_top}
SQL: dict[str, str] = {}
