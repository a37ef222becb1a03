"""Whole queries: search, lookup, show, graph, status."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomindex.functions import classify
from loomindex.functions.text import body_summary, snippet
from loomindex.operators import graph, results, scoring
from loomindex.operators.candidates import candidates, channels_of, contribution, exact_matches, fusion_score, kind_order
from loomindex.operators.postings import TextIndex
from loomindex.plans.spec import QuerySpec
from loomindex.session import materialize

PAYLOAD = ["id", "path", "language", "kind", "name", "signature", "doc", "fallback", "start_line", "start_column", "end_line", "end_column"]


def pool(symbols: DataFrame, spec: QuerySpec, embeddings: DataFrame | None = None, index: TextIndex | None = None) -> DataFrame:
    """The best candidates of a query by text, place and kind, before the graph is looked at."""
    found = materialize(candidates(symbols, spec, embeddings, index), "candidates")
    # Bodies are read for the few candidates only.
    rows = symbols.join(F.broadcast(found), "id").filter(scoring.fits_intent(spec)).withColumn("match", scoring.match(spec))
    base = fusion_score() if spec.hybrid else F.col("raw_score")
    confidence = F.col("match.confidence")
    adjusted = base + scoring.kind_score() + scoring.path_score(spec) + scoring.weak_doc_score(spec, confidence) + F.col("match.adjustment")
    extraction = classify.extraction_of(F.col("fallback"), F.col("doc"))
    scored = rows.select(
        *PAYLOAD, snippet(F.col("body")).alias("snippet"), confidence.alias("confidence"), F.col("match.reason").alias("reason"), extraction.alias("extraction"),
        classify.trust_of(extraction).alias("trust"), classify.retrieval_trust(extraction, confidence).alias("retrieval_trust"), "similarity", channels_of().alias("channels"),
        contribution().alias("contribution"), "lexical", "concept", "semantic", "raw_score", adjusted.alias("adjusted"),
    )
    # A few rows that later stages use several times.
    return materialize(scored.orderBy("adjusted", "raw_score", "id").limit(max(4 * spec.limit, 20)), "pool")


def search(symbols: DataFrame, relations: DataFrame, files: DataFrame, spec: QuerySpec, embeddings: DataFrame | None = None, width: int | None = None, index: TextIndex | None = None) -> DataFrame:
    """Ranked results of a query with graph support, relative scores and positions.

    ``width``: how many results before they are spread over files; by default as many as asked for.
    """
    best = pool(symbols, spec, embeddings, index)
    if not spec.docs_only:
        roots = graph.top_roots(files, symbols, max(4 * spec.limit, 20)) if spec.about_roots else None
        best = best.join(graph.graph_support(best, relations, roots), "id", "left")
    else:
        best = best.withColumn("graph_score", F.lit(None).cast("double")).withColumn("signals", F.lit(None).cast("array<string>"))
    ranked = best.withColumn("distance", F.col("adjusted") + F.coalesce("graph_score", F.lit(0.0))).withColumn("signals", F.coalesce("signals", F.array().cast("array<string>")))
    order = ["distance", "raw_score", "id"]
    placed = ranked.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    kept = results.collapse_documents(placed, spec).orderBy("position").limit(width or spec.limit)
    return results.relative_scores(kept.withColumn("position", F.row_number().over(Window.orderBy("position"))))


def query(symbols: DataFrame, relations: DataFrame, files: DataFrame, spec: QuerySpec, embeddings: DataFrame | None = None, index: TextIndex | None = None) -> DataFrame:
    """Search, then spread over files: the answer to a text query, in order of ``turn``."""
    wide = max(3 * spec.limit, spec.limit + 4)
    return results.diversify(search(symbols, relations, files, replace(spec, limit=wide), embeddings, index=index), spec.limit)


def best_by_name(symbols: DataFrame, name: str, top: int = 1) -> DataFrame:
    """The symbol that a name means best."""
    spec = QuerySpec(name)
    order = [F.col("level"), kind_order(["class", "module", "method", "function"]), F.col("start_line"), F.col("id")]
    first = exact_matches(symbols, spec).orderBy(*order).limit(50).select("id")
    rows = symbols.join(F.broadcast(first), "id").withColumn("similarity", F.lit(None).cast("double")).withColumn("match", scoring.match(spec))
    score = F.col("match.adjustment") + scoring.kind_score() + scoring.path_score(spec)
    return rows.select(*PAYLOAD, "body", score.alias("adjusted"), F.col("match.reason").alias("reason"), F.col("match.confidence").alias("confidence")).orderBy("adjusted", "start_line", "id").limit(top)


def lookup(symbols: DataFrame, relations: DataFrame, files: DataFrame, spec: QuerySpec, embeddings: DataFrame | None = None, index: TextIndex | None = None) -> DataFrame:
    """The best match of a query (role ``match``), symbols related to it, and the alternatives."""
    found = materialize(search(symbols, relations, files, spec, embeddings, index=index).select("id", "position"), "found")
    best = symbols.join(F.broadcast(found.filter("position = 1")), "id").select("id", "path", "start_line", "start_column", "end_line", "end_column")
    related = graph.traversal(symbols, relations, best, 5).select(F.col("neighbour_id").alias("id"), F.col("traversal").alias("role"), "place")
    ranked = found.select("id", F.when(F.col("position") == 1, "match").otherwise("alternative").alias("role"), F.col("position").alias("place"))
    return ranked.union(related)


def show(symbols: DataFrame, ids: list[int], full: bool = False) -> DataFrame:
    """Symbols by id with their bodies, shortened unless ``full``."""
    rows = symbols.filter(F.col("id").isin(*ids)) if ids else symbols.limit(0)
    shown = F.struct(F.lit("full").alias("mode"), F.col("body").alias("text")) if full else F.struct(body_summary(F.col("body"))["mode"].alias("mode"), body_summary(F.col("body"))["text"].alias("text"))
    return rows.select(*PAYLOAD, shown.alias("shown")).select(*PAYLOAD, "shown.mode", "shown.text")


def graph_around(symbols: DataFrame, relations: DataFrame, ids: list[int], limit: int = 20) -> DataFrame:
    """Neighbours of symbols, one list per kind of traversal."""
    chosen = symbols.filter(F.col("id").isin(*ids)) if ids else symbols.limit(0)
    return graph.traversal_groups(graph.traversal(symbols, relations, chosen, limit))


def status(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Per language: files, symbols, and how the symbols were extracted."""
    kind = classify.extraction_of(F.col("fallback"), F.col("doc"))
    s = symbols.groupBy("language").agg(F.count("*").alias("symbols"), *[F.count(F.when(kind == k, 1)).alias(k) for k in ("parsed", "recovered", "fallback")])
    f = files.groupBy("language").agg(F.count("*").alias("files"))
    counts = ["files", "symbols", "parsed", "recovered", "fallback"]
    return f.join(s, "language", "full_outer").select("language", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def overview(symbols: DataFrame, relations: DataFrame, files: DataFrame, embeddings: DataFrame | None = None, diff: DataFrame | None = None, samples: int = 5) -> DataFrame:
    """The state of an index as (section, name, value) rows: totals, extraction, relations, roots, possible orphans, vectors, freshness.

    ``diff``: (path, change) of the files against the index; without it there is no section on freshness.
    """
    kind = classify.extraction_of(F.col("fallback"), F.col("doc"))

    def rows(section: str, counted: DataFrame, name: Column, value: Column) -> DataFrame:
        return counted.select(F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("string").alias("value"))

    def count_by(section: str, table: DataFrame, by: Column) -> DataFrame:
        return rows(section, table.groupBy(by.alias("by")).agg(F.count("*").alias("n")), F.col("by"), F.col("n"))

    roots = graph.top_roots(files, symbols, samples)
    orphans = graph.possible_orphans(symbols, relations)
    parts = [
        *[rows("totals", t.agg(F.count("*").alias("n")), F.lit(name), F.col("n")) for name, t in (("files", files), ("symbols", symbols), ("relations", relations))],
        count_by("languages", files, F.col("language")),
        count_by("extraction", symbols, kind),
        count_by("relations", relations, F.col("relation_kind")),
        rows("roots", roots, F.col("path"), F.array_join("reasons", "; ")),
        rows("possible_orphans", orphans.agg(F.count("*").alias("n")), F.lit("symbols"), F.col("n")),
        rows("possible_orphans", orphans.orderBy("path", "id").limit(samples), F.col("path"), F.col("name")),
    ]
    if embeddings is not None:
        parts.append(count_by("vectors", embeddings.filter("size(embedding) > 0"), F.concat_ws("/", "provider", "model")))
    if diff is not None:
        parts.append(count_by("freshness", diff, F.col("change")))
        parts.append(rows("freshness", diff.agg((F.count("*") > 0).alias("stale")), F.lit("stale"), F.col("stale")))
    return reduce(DataFrame.unionByName, parts)
