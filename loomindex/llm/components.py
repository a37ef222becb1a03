"""Connected components of a set of links, by alternating large-star and small-star steps.

Every step links nodes to smaller nodes only, until each component is a star around its smallest node.
A step is one aggregate and one join; the number of rounds grows with the logarithm of the longest
chain. A node with very many links is pre-aggregated; its join is left to AQE's skew join. Each round is
written to the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomindex.session import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """(a, b) with b < a. Large: larger neighbours go to the smallest one; small: smaller neighbours and the node itself do."""
    if large:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every node that has a link; the component is its smallest node.

    ``links``: two columns of ids, in any order; nulls and loops are dropped. No links give no row.
    Raises if it has not settled after ``rounds`` rounds, rather than give a partial answer.
    """
    first, second = links.columns[:2]
    rows = links.select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b"), F.col(first).alias("x"), F.col(second).alias("y"))
    rows = rows.filter("x is not null and y is not null and a <> b").select("a", "b").distinct()
    current = materialize(rows, "links")
    mark = _mark(current)
    for _ in range(rounds):
        current = materialize(_star(_star(current, True), False), "links")
        now = _mark(current)
        if now == mark:
            roots = current.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
            return current.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
        mark = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
