"""Filling containers of fixed capacity with items: best fit decreasing.

Items are taken by falling size; each goes into the open container with the least room that still
takes it, found by a segment tree over remaining capacities in logarithmic time. An item larger than
the capacity is cut into full pieces and a rest; no other item is cut.

Scale: items are dealt by hash to shards of about ``shard_items``, packed one shard a group. A shard
wastes at most the room of its few last containers, so many shards cost nothing measurable; the
report compares with the least number of containers that any packing needs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomindex.session import materialize


class RoomTree:
    """For each remaining capacity, whether a container with just that room is open; a segment tree of flags."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.any = bytearray(2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, container: int) -> None:
        self.open.setdefault(room, []).append(container)
        at = room + self.leaves
        while at and not self.any[at]:
            self.any[at] = 1
            at //= 2

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, container) of the tightest container with room for ``size``; it is taken out."""
        at = size + self.leaves
        if not self.any[at]:
            # Up until a right neighbour has something, then down to its first leaf.
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        room = at - self.leaves
        container = self.open[room].pop()
        if not self.open[room]:
            self.any[at] = 0
            while at > 1:
                at //= 2
                self.any[at] = self.any[2 * at] | self.any[2 * at + 1]
        return room, container


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item; sizes must not exceed the capacity. Ties keep the given order."""
    tree, out, used = RoomTree(capacity), np.zeros(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        found = tree.take(size)
        if found is None:
            found = capacity, used
            used += 1
        room, out[i] = found
        tree.add(room - size, int(out[i]))
    return out


def _pack(table: pa.Table) -> pa.Table:
    table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
    sizes = table["tokens"].to_numpy()
    capacity = table["capacity_tokens"][0].as_py()
    return pa.table({"limit_id": table["limit_id"], "capacity_tokens": table["capacity_tokens"], "shard": table["shard"], "container": best_fit_decreasing(sizes, capacity), "doc_id": table["doc_id"], "piece": table["piece"], "tokens": table["tokens"]})


def pack(sizes: DataFrame, limits: DataFrame, shard_items: int = 50_000) -> DataFrame:
    """One row per placed piece: limit_id, capacity_tokens, container_id (unique within a limit), doc_id, piece, tokens.

    ``sizes``: doc_id, tokens. ``limits``: limit_id, capacity_tokens; each limit packs all items by
    itself. Items of size 0 are placed too. Null or non-positive capacities are no limits; empty
    tables give no row; repeated limits count once.
    """
    items = materialize(sizes.select("doc_id", "tokens"), "sizes")
    wanted = limits.filter("limit_id is not null and capacity_tokens > 0").groupBy("limit_id").agg(F.min("capacity_tokens").alias("capacity_tokens"))
    # A limits table has a few rows; it is made an array column, so that each item meets each limit without a join.
    found = [(r.limit_id, r.capacity_tokens) for r in wanted.collect()]
    schema = "limit_id int, capacity_tokens int, container_id string, doc_id bigint, piece int, tokens bigint"
    if not found:
        return items.sparkSession.createDataFrame([], schema)
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("int").alias("limit_id"), F.lit(c).cast("int").alias("capacity_tokens")) for i, c in found])).alias("limit")
    rows = items.select("doc_id", "tokens", each).select("doc_id", "tokens", "limit.*")
    cuts = F.greatest(F.ceil(F.col("tokens") / F.col("capacity_tokens")), F.lit(1)).cast("int")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), cuts - 1)))
    rest = F.col("tokens") - F.col("piece").cast("long") * F.col("capacity_tokens")
    pieces = pieces.withColumn("tokens", F.least(rest, F.col("capacity_tokens").cast("long")))
    whole = F.col("tokens") == F.col("capacity_tokens")
    # Full pieces need no search: each is a container of its own.
    alone = pieces.filter(whole).select(
        "limit_id", "capacity_tokens", F.concat_ws(".", F.lit("full"), "doc_id", "piece").alias("container_id"), "doc_id", "piece", "tokens"
    )
    shards = max(1, math.ceil(items.count() / shard_items))
    open_pieces = pieces.filter(~whole).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    packed = open_pieces.groupBy("limit_id", "shard").applyInArrow(_pack, schema.replace("container_id string", "shard bigint, container bigint"))
    named = F.concat_ws(".", F.lit("shard"), "shard", "container").alias("container_id")
    return packed.select("limit_id", "capacity_tokens", named, "doc_id", "piece", "tokens").union(alone)


def pack_report(packed: DataFrame) -> DataFrame:
    """Per limit: items, pieces, tokens, containers, share of room filled, and the least possible number of containers."""
    return (
        packed.groupBy("limit_id", "capacity_tokens", "container_id")
        .agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
        .groupBy("limit_id", "capacity_tokens")
        .agg(F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.count("*").alias("containers"), F.max("tokens").alias("fullest"))
        .withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")))
        .withColumn("filled_share", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
    )
