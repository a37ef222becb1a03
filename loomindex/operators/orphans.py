"""References to records that do not exist.

Keys, whether paths or ids, are dictionary-encoded as dense integers; the referenced codes are kept as
one compressed bitmap per reference field, month and key range, and a reference is an orphan where its
bit is set and the parent's is not. Surviving bits are decoded to keys and joined back to the rows that
hold them.

Scale: only distinct keys are encoded (map-side distinct before each shuffle), and bitmaps are packed
before they are exchanged. In the join back to rows, only keys with more than ``HOT`` rows are salted,
over as many tasks as they have multiples of that; there are at most rows / ``HOT`` of these. Nothing is
collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomindex.functions import bitmaps
from loomindex.functions.paths import canonical_path
from loomindex.session import materialize

PATH_FIELDS = ("source_path", "target_path")
#: Rows of one key that one task takes.
HOT = 500_000


def present_paths(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Paths in ``files`` whose newest change (by seen_at, then change_id) is not a deletion.

    A path without any change is present; changes without a time count as older than all others.
    """
    newest = F.max(F.struct("seen_at", "change_id", "change_kind")).alias("newest")
    gone = (
        changes.filter("path is not null")
        .groupBy(canonical_path(F.col("path")).alias("path"))
        .agg(newest)
        .filter("newest.change_kind = 'deleted'")
        .select("path")
    )
    paths = files.filter("path is not null").select(canonical_path(F.col("path")).alias("path")).distinct()
    return paths.join(gone, "path", "left_anti")


def month_of(at: Column) -> Column:
    """``yyyy-MM``; a row without a time is in period ``unknown``."""
    return F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("unknown"))


def _dictionary(keys: DataFrame) -> DataFrame:
    """canonical -> code. Codes are dense within a partition, so key ranges are well filled.

    Written once: the numbering must not change when a task is repeated.
    """
    return materialize(keys.distinct().withColumn("code", F.monotonically_increasing_id()), "dictionary")


def _missing(coded: DataFrame, parents: DataFrame) -> DataFrame:
    """(ref_field, period, code) of referenced codes without a parent, by AND-NOT of bitmaps."""
    refs = bitmaps.bitmaps(coded, "ref_field", "period").withColumnRenamed("bits", "refs")
    there = bitmaps.bitmaps(parents).withColumnRenamed("bits", "parents")
    both = refs.join(there, "key_range", "left").select("ref_field", "period", "key_range", "refs", "parents")
    return both.mapInArrow(bitmaps.and_not, "ref_field string, period string, code bigint")


def _orphan_rows(refs: DataFrame, usage: DataFrame, present: DataFrame) -> DataFrame:
    """The rows of ``refs`` (relation_id, ref_field, period, key) whose key is missing.

    ``usage``: (ref_field, period, key, rows, canonical), one row per distinct reference; ``present``: (canonical) of the parents.
    """
    codes = _dictionary(usage.select("canonical").union(present))
    coded = materialize(usage.join(codes, "canonical").select("ref_field", "period", "key", "rows", "code"), "usage")
    lost = _missing(coded.select("ref_field", "period", "code"), present.join(codes, "canonical").select("code"))
    on = ["ref_field", "period", "key"]
    parts = F.ceil(F.col("rows") / F.lit(HOT)).cast("int")
    orphans = coded.join(lost.distinct(), ["ref_field", "period", "code"], "left_semi").select(*on, parts.alias("parts"))
    hot = coded.filter(F.col("rows") > HOT).select(*on, parts.alias("parts"))  # at most rows / HOT of them
    salted = refs.join(hot, on, "left").withColumn("salt", F.pmod(F.xxhash64("relation_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    keys = orphans.select(*on, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    return salted.join(keys, [*on, "salt"], "left_semi").select("relation_id", "ref_field", "period")


def orphan_references(relations: DataFrame, symbols: DataFrame, files: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per orphan reference: relation_id, ref_field, period.

    Null and blank keys are no references. Rows delivered twice give one row. Empty tables are
    allowed: without parents every reference is an orphan. Other columns of the inputs are ignored.
    """
    rows = relations.select(
        F.col("id").alias("relation_id"), month_of(F.col("indexed_at")).alias("period"), "source_symbol_id", *PATH_FIELDS
    )
    count = F.count("*").alias("rows")
    id_refs = rows.filter("source_symbol_id is not null").select(
        "relation_id", F.lit("source_symbol_id").alias("ref_field"), "period", F.col("source_symbol_id").alias("key")
    )
    id_usage = id_refs.groupBy("ref_field", "period", "key").agg(count).withColumn("canonical", F.col("key"))
    by_id = _orphan_rows(id_refs, id_usage, symbols.filter("id is not null").select(F.col("id").alias("canonical")).distinct())

    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), F.col(f).alias("key")) for f in PATH_FIELDS])).alias("ref")
    path_refs = (
        rows.select("relation_id", "period", fields).select("relation_id", "period", "ref.ref_field", "ref.key").filter(F.col("key").rlike(r"\S"))
    )
    path_usage = path_refs.groupBy("ref_field", "period", "key").agg(count).withColumn("canonical", canonical_path(F.col("key")))
    present = materialize(present_paths(files, changes).select(F.col("path").alias("canonical")), "present")
    by_path = _orphan_rows(path_refs, path_usage, present)
    return by_id.union(by_path).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphan references per referenced table and month."""
    referenced = F.when(F.col("ref_field") == "source_symbol_id", F.lit("symbols")).otherwise(F.lit("files"))
    return orphans.groupBy(referenced.alias("referenced_table"), "ref_field", "period").agg(F.count("*").alias("orphans"))
