"""Registered queries of the near-duplicate operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomindex.llm.components import components
from loomindex.llm.neardup import NearDuplicates, identity_of
from loomindex.session import materialize
from loomindex.sources.tables import table


def _symbols(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "symbols").select("id", identity_of("path", "kind", "name", "signature").alias("identity"), F.col("body").alias("text"))


def _near(symbols: DataFrame) -> NearDuplicates:
    """Three words, 0.6 and 20 runs, as TESTDATA.md has it for this problem."""
    return NearDuplicates(symbols, width=3, threshold=0.6, least=20)


def _members(symbols: DataFrame, near: NearDuplicates) -> DataFrame:
    """(id, rep) of every id: those in ``near``, and those without runs by their whole normalised text.

    Null and blank texts are each their own class. Of different texts without runs of one id, the one with the least hash counts.
    """
    normal = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    keyed = symbols.filter("id is not null").select("id", F.when(normal != "", F.sha2(normal, 256)).alias("key"))
    rest = keyed.groupBy("id").agg(F.min("key").alias("key")).join(near.members.select("id"), "id", "left_anti")
    rest = materialize(rest, "without-runs")
    reps = rest.filter("key is not null").groupBy("key").agg(F.min("id").alias("rep"))
    return near.members.select("id", "rep").unionByName(rest.join(reps, "key", "left").select("id", F.coalesce("rep", "id").alias("rep")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of symbols whose bodies share 0.6 of their three-word runs, as TESTDATA.md defines them.

    The operator gives pairs of classes and the members of each class; here they are spelled out as
    pairs of ids, since that is the stated form.
    """
    near = _near(_symbols(spark, folder))
    members = near.members.select("id", "identity", "rep")
    sides = {x: members.select(F.col("id").alias(f"id_{x}"), F.col("identity").alias(f"identity_{x}"), F.col("rep").alias(f"rep_{x}")) for x in "ab"}
    between = near.pairs().select("rep_a", "rep_b").join(sides["a"], "rep_a").join(sides["b"], "rep_b").filter("identity_a <> identity_b")
    # Within a class, pairs of identities come first, so that copies that agree in all of it meet nothing.
    kinds = members.select("rep", "identity").distinct()
    several = kinds.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1").select("rep")
    kinds = kinds.join(several, "rep", "left_semi")
    unlike = kinds.select("rep", F.col("identity").alias("identity_a")).join(kinds.select("rep", F.col("identity").alias("identity_b")), "rep").filter("identity_a < identity_b")
    within = unlike.select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"), "identity_a", "identity_b").join(sides["a"], ["rep_a", "identity_a"]).join(sides["b"], ["rep_b", "identity_b"])
    pairs = between.select("id_a", "id_b").union(within.select("id_a", "id_b")).filter("id_a <> id_b")
    return pairs.select(F.least("id_a", "id_b").alias("symbol_a"), F.greatest("id_a", "id_b").alias("symbol_b")).distinct()


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per symbol: its class of equal bodies, the class's size and number of linked classes.

    Three words and 0.6 as in ``p1_found``, texts of fewer than 20 runs by equality alone; copies are not expanded into pairs, so its size is that of the input.
    """
    symbols = _symbols(spark, folder)
    near = _near(symbols)
    pairs = near.pairs()
    links = pairs.select(F.col("rep_a").alias("rep")).union(pairs.select(F.col("rep_b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    members = _members(symbols, near)
    sizes = members.groupBy("rep").agg(F.count("*").alias("copies"))
    return (
        members.join(sizes, "rep")
        .join(links, "rep", "left")
        .select(F.col("id").alias("symbol_id"), F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    )


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per symbol that is an exact or edited copy of others: its group, by chains of links (three words, 0.6)."""
    symbols = _symbols(spark, folder)
    near = _near(symbols)
    groups = components(near.pairs().select("rep_a", "rep_b"))
    joined = _members(symbols, near).join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    grouped = joined.select(F.col("id").alias("symbol_id"), F.coalesce("component", "rep").alias("group_id"))
    several = grouped.groupBy("group_id").agg(F.count("*").alias("symbols")).filter("symbols > 1")
    return grouped.join(several, "group_id")


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p1_groups": p1_groups}
SQL: dict[str, str] = {}
