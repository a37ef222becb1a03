"""Channels that propose symbols for a query, their merge, and their raw scores.

Every channel is a filter and a top-k over the symbols; none carries ``body`` beyond its filter, so the
wide column is only read where it is matched (late materialisation by id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomindex.functions import classify
from loomindex.functions.text import cosine, lookup_key, stored_key
from loomindex.operators.postings import TextIndex, bm25
from loomindex.plans.spec import QuerySpec
from loomindex.plans.spec import lookup_key as key_of
from loomindex.session import materialize

LEAST_SIMILARITY = 0.6
CHANNELS = ["raw_score double", "similarity double", "lexical boolean", "concept boolean", "semantic boolean", "lexical_rank int", "concept_rank int", "semantic_rank int"]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions, F.lit(False))


def first_true(conditions: list[Column]) -> Column:
    """Number of the first condition that holds; their count if none does. Nulls do not hold."""
    out = F.lit(len(conditions))
    for i in reversed(range(len(conditions))):
        out = F.when(F.coalesce(conditions[i], F.lit(False)), F.lit(i)).otherwise(out)
    return out


def kind_order(kinds: list[str]) -> Column:
    return first_true([F.col("kind") == k for k in kinds])


def of_kinds(symbols: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Only these kinds, if any are given; applied before any limit."""
    return symbols.filter(F.col("kind").isin(*kinds)) if kinds else symbols


def _channel(rows: DataFrame, **given: Column) -> DataFrame:
    columns = []
    for part in CHANNELS:
        name, kind = part.split()
        default = F.lit(False) if kind == "boolean" else F.lit(None)
        columns.append(given.get(name, default).cast(kind).alias(name))
    return rows.select("id", *columns)


def _ranked(top: DataFrame, order: list[Column]) -> DataFrame:
    """Positions 1.. of a frame that a limit already made small."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def lexical(symbols: DataFrame, spec: QuerySpec, index: TextIndex | None = None) -> DataFrame:
    """BM25 top-k."""
    n = max(10 * spec.limit, 100)
    order = [F.col("raw_score"), F.col("id")]
    top = bm25(symbols, spec.phrases, spec.kinds, index).orderBy(*order).limit(n)
    return _channel(_ranked(top, order), raw_score=F.col("raw_score"), lexical=F.lit(True), lexical_rank=F.col("rank"))


def literal_matches(symbols: DataFrame, spec: QuerySpec) -> DataFrame:
    """Symbols that hold the query as it stands, or squeezed, in path, name, signature, doc or body; unranked."""
    text = [F.coalesce(F.col(c), F.lit("")) for c in ("path", "name", "signature", "doc", "body")]
    plain = [F.lower(c).contains(spec.lowered) for c in text]
    squeezed = [lookup_key(c).contains(spec.key) for c in text] if spec.key else []
    level = first_true([F.lower("name") == spec.lowered, F.lower("signature").contains(spec.lowered), F.lower("body").contains(spec.lowered)])
    same_name = (F.lower("name") == spec.lowered) | ((lookup_key(F.col("name")) == spec.key) if spec.key else F.lit(False))
    in_body = F.lower("body").contains(spec.lowered) | (lookup_key(F.col("body")).contains(spec.key) if spec.key else F.lit(False))
    raw = F.when(same_name, -6.5).when(F.lower("signature").contains(spec.lowered), -5.0).when(in_body, -4.0).otherwise(-2.5)
    return (
        of_kinds(symbols, spec.kinds)
        .filter(any_of(plain + squeezed))
        .select("id", "start_line", level.alias("level"), kind_order(["class", "function", "heading"]).alias("kind_order"), raw.alias("raw_score"))
    )


def literal(symbols: DataFrame, spec: QuerySpec) -> DataFrame:
    order = [F.col("level"), F.col("kind_order"), F.col("start_line"), F.col("id")]
    top = literal_matches(symbols, spec).orderBy(*order).limit(max(10 * spec.limit, 100))
    return _channel(_ranked(top, order), raw_score=F.col("raw_score"), lexical=F.lit(True), lexical_rank=F.col("rank"))


def exact_matches(symbols: DataFrame, spec: QuerySpec) -> DataFrame:
    """Symbols whose name, signature or path is the query, plain, squeezed or qualified, with their level."""
    lowered = [v.lower() for v in spec.variants]
    keys = [k for k in dict.fromkeys(key_of(v) for v in spec.variants) if k]
    plain = [F.lower(F.trim(F.col(c))).isin(lowered) for c in ("name", "signature", "path")]
    squeezed = [stored_key(F.coalesce(F.col(c), F.lit(""))).isin(keys) if keys else F.lit(False) for c in ("name", "signature", "path")]
    # As the first variant only: longer signatures may end in a qualified name.
    suffix = stored_key(F.col("signature")).endswith(keys[0]) if keys else F.lit(False)
    levels = [*plain, *squeezed, suffix]
    return (
        of_kinds(symbols, spec.kinds)
        .select("id", "kind", "name", "signature", "path", "start_line")
        .withColumn("level", first_true(levels))
        .filter(F.col("level") < len(levels))
    )


def exact_raw_score(spec: QuerySpec) -> Column:
    """Score of an exact match, deep enough for full qualified names to beat any text score."""
    name, signature, path = (F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in ("name", "signature", "path"))
    q = spec.lowered
    score = F.when(name == q, -7.5).when(signature == q, -7.0).when(path == q, -6.5)
    if spec.segments:
        container = F.col("kind").isin("class", "module")
        score = score.when(container & (bare_signature() == q), -35.0)
        if len(spec.segments) >= 3:
            score = score.when(container & namespace_evidence(spec) & (name == spec.segments[-1].lower()), -10.0)
    return score.otherwise(-6.0)


def bare_signature() -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(F.col("signature"), F.lit("")), r"^(class|module)\s+", "")))


def namespace_evidence(spec: QuerySpec) -> Column:
    """Whether signature or path show the namespace that a qualified query names."""
    ends = [classify.folded(F.col("path")).endswith(s) for s in spec.path_suffixes]
    return any_of([F.lower(F.coalesce(F.col("signature"), F.lit(""))).contains(spec.lowered), *ends])


def exact(symbols: DataFrame, spec: QuerySpec) -> DataFrame:
    order = [F.col("level"), kind_order(["class", "function", "selector", "key", "stage", "file"]), F.col("start_line"), F.col("id")]
    top = exact_matches(symbols, spec).orderBy(*order).limit(max(2 * spec.limit, 10))
    return _channel(top, raw_score=exact_raw_score(spec), lexical=F.lit(True))


def concept_matches(symbols: DataFrame, spec: QuerySpec) -> DataFrame:
    """Symbols in files whose path holds every concept of the query."""
    path = classify.folded(F.col("path"))
    every = reduce(lambda x, y: x & y, [path.contains(t) for t in spec.concepts], F.lit(bool(spec.concepts)))
    whole = lookup_key(F.col("path")).contains(spec.key)
    return (
        of_kinds(symbols, spec.kinds)
        .filter(every & ~F.col("kind").isin("import", "file"))
        .select("id", "path", "kind", "language", "start_line", F.when(whole, 0).otherwise(1).alias("level"))
    )


def concept(symbols: DataFrame, spec: QuerySpec) -> DataFrame:
    order = [F.col("level"), kind_order(["class", "function", "heading"]), F.col("start_line"), F.col("id")]
    top = concept_matches(symbols, spec).orderBy(*order).limit(max(10 * spec.limit, 100))
    ranked = _ranked(top, order)
    from loomindex.operators.scoring import concept_path_match

    strength = concept_path_match(spec)["confidence"]
    raw = F.when(strength == "strong", -7.5).when(strength == "related", -5.5).otherwise(-2.5)
    return _channel(ranked, raw_score=raw, concept=F.lit(True), concept_rank=F.col("rank"))


def similar(embeddings: DataFrame, vector: list[float] | tuple[float, ...], model: str | None, provider: str | None = None, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(id, similarity) of vectors at least that similar; null elements and empty vectors do not match."""
    rows = embeddings.filter("symbol_id is not null and embedding is not null")
    if model is not None:
        rows = rows.filter(F.col("model") == model)
    if provider is not None:
        rows = rows.filter(F.col("provider") == provider)
    finite = F.filter("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    query = F.array(*[F.lit(float(x)) for x in vector]) if vector else F.array().cast("array<double>")
    scored = rows.select(F.col("symbol_id").alias("id"), cosine(finite, query).alias("similarity"))
    return scored.groupBy("id").agg(F.round(F.max("similarity"), 9).alias("similarity")).filter(F.col("similarity") >= least)


def semantic(symbols: DataFrame, embeddings: DataFrame, spec: QuerySpec) -> DataFrame:
    """Cosine top-k; the rank follows the similarity."""
    order = [F.desc("similarity"), F.col("id")]
    there = of_kinds(symbols, spec.kinds).select("id")
    found = similar(embeddings, spec.vector, spec.model, spec.provider)
    top = found.join(there, "id", "left_semi").orderBy(*order).limit(max(10 * spec.limit, 100))
    return _channel(_ranked(top, order), raw_score=F.lit(0.0), similarity=F.col("similarity"), semantic=F.lit(True), semantic_rank=F.col("rank"))


def merged(channels: list[DataFrame]) -> DataFrame:
    """One row per symbol: best score and similarity, channels it came by, best ranks."""
    rows = reduce(DataFrame.unionByName, channels)
    best = [F.min("raw_score").alias("raw_score"), F.max("similarity").alias("similarity")]
    flags = [F.bool_or(c).alias(c) for c in ("lexical", "concept", "semantic")]
    ranks = [F.min(c).alias(c) for c in ("lexical_rank", "concept_rank", "semantic_rank")]
    return rows.groupBy("id").agg(*best, *flags, *ranks)


def fusion_score() -> Column:
    """Score of a merged row from its ranks and similarity, for queries with a vector."""
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (F.col(rank) + 1), F.lit(0.0))
    total = part(3.4, "lexical_rank") + part(2.8, "concept_rank") + part(5.8, "semantic_rank") + F.lit(2.1) * F.coalesce("similarity", F.lit(0.0))
    return -total - F.when(F.col("semantic") & ~F.col("lexical") & ~F.col("concept"), 0.75).otherwise(0.0)


def channels_of() -> Column:
    return F.array_compact(F.array(F.when(F.col("lexical"), "lexical"), F.when(F.col("concept"), "concept_path"), F.when(F.col("semantic"), "semantic")))


def contribution() -> Column:
    return F.when(~F.col("semantic"), "lexical_only").when(F.col("lexical") | F.col("concept"), "semantic_assisted").otherwise("semantic_only")


def candidates(symbols: DataFrame, spec: QuerySpec, embeddings: DataFrame | None = None, index: TextIndex | None = None) -> DataFrame:
    """All channels of a query, merged. The literal channel stands in where the index finds nothing."""
    by_index = materialize(lexical(symbols, spec, index), "lexical")
    # The literal channel is only needed if the index has no hit; one row tells.
    text = by_index if spec.phrases and not by_index.limit(1).isEmpty() else literal(symbols, spec)
    parts = [text, exact(symbols, spec)]
    if spec.uses_concepts:
        parts.append(concept(symbols, spec))
    if spec.hybrid and embeddings is not None:
        parts.append(semantic(symbols, embeddings, spec))
    return merged(parts)
