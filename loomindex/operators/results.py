"""What happens to ranked results: duplicates, relative scores, spreading over files, groups, quality.

These frames are small (at most a query's pool), so their windows without partition are cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomindex.functions import classify
from loomindex.functions.text import half_up, lookup_key
from loomindex.plans.spec import QuerySpec


def collapse_documents(results: DataFrame, spec: QuerySpec) -> DataFrame:
    """Keeps the first of equal operational documents where the best match is weak. ``position`` orders the rows."""
    if not spec.hides_operational_docs:
        return results
    key = F.when(classify.is_operational_doc(F.col("path")), F.concat_ws("|", lookup_key(F.col("name")), F.substring(lookup_key(F.col("snippet")), 1, 120)))
    top = F.first("confidence").over(Window.orderBy("position"))
    marked = results.withColumn("_key", key).withColumn("_top", top)
    place = F.row_number().over(Window.partitionBy("_key").orderBy("position"))
    kept = marked.withColumn("_n", place).filter(F.col("_key").isNull() | (F.col("_n") == 1) | ~F.col("_top").isin("related", "fallback"))
    return kept.drop("_key", "_top", "_n")


def relative_scores(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds ``score`` and ``margin`` of ``distance`` between the best (1, 0) and the worst; without spread all are best."""
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    best, worst = F.min("distance").over(w), F.max("distance").over(w)
    margin = F.when(worst > best, (F.col("distance") - best) / (worst - best)).otherwise(0.0)
    return results.withColumn("margin", half_up(margin)).withColumn("score", half_up(F.lit(1.0) - margin))


def diversify(results: DataFrame, limit: int, by: list[str] | None = None) -> DataFrame:
    """The first result stays first; then files take turns. Adds ``turn`` (the new position), keeps ``limit`` rows.

    Up to ``limit`` rows stay in their order.
    """
    group = by or []
    whole = Window.partitionBy(*group)
    first = F.col("_first") == F.col("position")
    rows = results.withColumn("_first", F.min("position").over(whole)).withColumn("_n", F.count("*").over(whole))
    rounds = F.row_number().over(Window.partitionBy(*group, "path", first).orderBy("position"))
    start = F.min("position").over(Window.partitionBy(*group, "path", first))
    place = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("long").alias("b"), F.col("position").cast("long").alias("c"))
    key = F.when(first | (F.col("_n") <= limit), place(F.lit(0), F.lit(0))).otherwise(place(F.col("_round"), F.col("_start")))
    keyed = rows.withColumn("_round", rounds).withColumn("_start", start).withColumn("_key", key)
    turned = keyed.withColumn("turn", F.row_number().over(whole.orderBy("_key")))
    return turned.filter(F.col("turn") <= limit).drop("_first", "_n", "_round", "_start", "_key")


def file_groups(results: DataFrame, position: str = "position") -> DataFrame:
    """Per file: hits, up to three kinds and names in order of appearance, and where it first appears."""
    ordered = lambda c: F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(position, c))), lambda x: x[c])), 1, 3)
    return results.groupBy("path").agg(F.min(position).alias("first_position"), F.count("*").alias("hits"), ordered("kind").alias("kinds"), ordered("name").alias("names"))


def is_strong(confidence: Column, trust: Column) -> Column:
    return (confidence == "exact") | ((confidence == "strong") & (trust != "low"))


def quality(results: DataFrame) -> DataFrame:
    """One row: how good the results are as a whole (level, reason, no_strong_match, counts).

    ``results``: position, confidence, retrieval_trust, similarity, margin, contribution.
    """
    top = F.min_by(F.struct("confidence", "retrieval_trust", "similarity", "margin", "contribution"), "position").alias("top")
    facts = results.agg(F.count("*").alias("results"), F.count(F.when(is_strong(F.col("confidence"), F.col("retrieval_trust")), 1)).alias("strong_matches"), top)
    t = lambda c: F.col(f"top.{c}")
    confirmed = (
        (t("similarity") >= 0.7) & (t("margin") >= 0.15) & (t("confidence") == "related") & (t("retrieval_trust") == "high") & (t("contribution") != "lexical_only")
    )
    usable = ((t("confidence") == "related") & (t("retrieval_trust") != "low")) | (t("confidence") == "strong")
    say = lambda level, reason, nothing: F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"), F.lit(nothing).alias("no_strong_match"))
    verdict = (
        F.when(F.col("results") == 0, say("none", "no_results", True))
        .when(is_strong(t("confidence"), t("retrieval_trust")), say("strong", "top_result_strong", False))
        .when(confirmed, say("strong", "top_result_semantically_confirmed", False))
        .when(F.col("strong_matches") > 0, say("moderate", "strong_match_present", False))
        .when(usable, say("moderate", "related_but_actionable", True))
        .otherwise(say("weak", "only_weak_matches", True))
    )
    return facts.select(verdict.alias("v"), "results", "strong_matches").select("v.*", "results", "strong_matches")


def channel_counts(pool: DataFrame) -> DataFrame:
    """One row: candidates by channel, and the most similar of them."""
    count = lambda c: F.count(F.when(F.col(c), 1)).alias(f"{c}_candidates")
    return pool.agg(count("lexical"), count("concept"), count("semantic"), F.max_by("id", F.struct("similarity", -F.col("id"))).alias("most_similar_id"), F.max("similarity").alias("similarity"))
