"""Channels, scores and whole searches over the symbols table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from loomindex.functions import classify
from loomindex.operators import candidates as c
from loomindex.operators import postings as p
from loomindex.operators import results, scoring
from loomindex.plans import search as plans
from loomindex.plans.spec import QuerySpec
from loomindex.queries import graph_queries as gq
from loomindex.queries import search_sql as sq
from loomindex.queries import sqltext as q
from loomindex.plans.opened import open_index
from loomindex.sources import tables

CONCEPT = QuerySpec("resolve the menu report")
BROAD = QuerySpec("parser window table", limit=10)
PLACE = QuerySpec("cobalt bundle")
SYMBOL = QuerySpec("mergeKey")
SNAKE = QuerySpec("queue_result")
QUALIFIED = QuerySpec("Core::Index::run")
TYPED = QuerySpec("functions that accept a worker account argument")
CODE = QuerySpec("cache window", prefer_implementation=True, exclude_tests=True, kinds=("function", "method", "class"))
MODEL, PROVIDER = "plume-small", "local-runner"


def _s(spark, folder):
    return open_index(spark, folder).symbols


def _i(spark, folder):
    return open_index(spark, folder).text


def _with_vector(spark, folder, spec):
    """The spec with the first usable vector of the model as its query vector (one row)."""
    rows = tables.table(spark, folder, "symbol_embeddings").filter((F.col("model") == MODEL) & F.col("embedding").isNotNull() & (F.size("embedding") == F.col("dimensions")) & F.col("symbol_id").isNotNull())
    first = rows.orderBy("symbol_id", "embedding").select("embedding").limit(1).collect()
    return replace(spec, vector=tuple(0.0 if x is None else x for x in first[0][0]) if first else (), model=MODEL, provider=PROVIDER)


def postings_table(spark, folder):
    """Size of the full-text index by field and term."""
    return p.postings(_s(spark, folder)).groupBy("term", "field").agg(F.count("*").alias("occurrences"), F.countDistinct("symbol_id").alias("symbols"))


def bm25_scores(spark, folder):
    return p.bm25(_s(spark, folder), CONCEPT.phrases, index=_i(spark, folder)).select("id", F.round("raw_score", 6).alias("raw_score"))


def bm25_phrase(spark, folder):
    return p.bm25(_s(spark, folder), SNAKE.phrases, index=_i(spark, folder)).select("id", F.round("raw_score", 6).alias("raw_score"))


def bm25_topk(spark, folder):
    top = c.lexical(_s(spark, folder), CONCEPT, _i(spark, folder))
    return top.select("id", F.round("raw_score", 6).alias("raw_score"), F.col("lexical_rank").cast("long").alias("lexical_rank"))


def literal_search(spark, folder):
    found = c.literal_matches(_s(spark, folder), SYMBOL)
    return found.select("id", "raw_score", F.col("level").cast("long").alias("level"), F.col("kind_order").cast("long").alias("kind_order"))


def exact_lookup(spark, folder):
    return c.exact_matches(_s(spark, folder), SNAKE).select("id", F.col("level").cast("long").alias("level"))


def concept_path(spark, folder):
    return c.concept_matches(_s(spark, folder), PLACE).select("id", F.col("level").cast("long").alias("level"))


def semantic_matches(spark, folder):
    spec = _with_vector(spark, folder, CONCEPT)
    return c.similar(tables.embeddings(spark, folder), spec.vector, MODEL, PROVIDER, -2.0).select("id", F.round("similarity", 6).alias("similarity"))


def semantic_topk(spark, folder):
    spec = _with_vector(spark, folder, CONCEPT)
    top = c.semantic(_s(spark, folder), tables.embeddings(spark, folder), spec)
    return top.select("id", F.round("similarity", 6).alias("similarity"), F.col("semantic_rank").cast("long").alias("semantic_rank"))


def _merged(spark, folder, spec):
    spec = _with_vector(spark, folder, spec)
    return c.candidates(_s(spark, folder), spec, tables.embeddings(spark, folder), _i(spark, folder))


def merged_channels(spark, folder):
    rows = _merged(spark, folder, BROAD)
    ranks = [F.coalesce(F.col(x).cast("long"), F.lit(0)).alias(x) for x in ("lexical_rank", "concept_rank", "semantic_rank")]
    return rows.select("id", F.round("raw_score", 6).alias("raw_score"), F.round("similarity", 6).alias("similarity"), "lexical", "concept", "semantic", *ranks)


def hybrid_fusion(spark, folder):
    rows = _merged(spark, folder, BROAD)
    return rows.select("id", F.round(c.fusion_score(), 6).alias("score"), F.array_join(c.channels_of(), ",").alias("channels"), c.contribution().alias("contribution"))


def _cascade(spec):
    def run(spark, folder):
        rows = _s(spark, folder).withColumn("similarity", F.lit(None).cast("double"))
        return rows.select("id", scoring.match(spec).alias("m")).select("id", F.round("m.adjustment", 6).alias("adjustment"), "m.reason", "m.confidence")

    return run


def _places(spec):
    def run(spark, folder):
        return _s(spark, folder).select("id", F.round(scoring.kind_score(), 6).alias("kind_score"), F.round(scoring.path_score(spec), 6).alias("path_score"))

    return run


def _pool(spec, hybrid=False):
    def run(spark, folder):
        known = _with_vector(spark, folder, spec) if hybrid else spec
        rows = plans.pool(_s(spark, folder), known, tables.embeddings(spark, folder) if hybrid else None, _i(spark, folder))
        return rows.select("id", "reason", "confidence", F.round("adjusted", 6).alias("adjusted"))

    return run


def best_by_name(spark, folder):
    """For a name that many symbols share: all its candidates with score, best first."""
    rows = plans.best_by_name(_s(spark, folder), "run", 10)
    return rows.select("id", F.round("adjusted", 6).alias("adjusted"), "reason", "confidence")


def _search(spec):
    def run(spark, folder):
        rows = plans.query(_s(spark, folder), open_index(spark, folder).relations, open_index(spark, folder).files, spec, index=_i(spark, folder))
        return rows.select(F.col("turn").cast("long").alias("turn"), "id", "path", "kind", "name", "confidence", "reason", "retrieval_trust", F.round("distance", 6).alias("distance"), "score", "margin", F.array_join("signals", ",").alias("signals"))

    return run


def _ranked_by_file(spark, folder):
    """Every class and function ranked within its language by name length: results of many queries at once."""
    s = _s(spark, folder).filter("kind in ('class', 'function')")
    from pyspark.sql.window import Window

    order = Window.partitionBy("language").orderBy(F.length("name"), "id")
    return s.select("id", "path", "kind", "name", "language", F.length("name").cast("double").alias("distance"), F.row_number().over(order).alias("position"))


def diversified(spark, folder):
    rows = results.diversify(_ranked_by_file(spark, folder), 50, by=["language"])
    return rows.select("language", "id", F.col("turn").cast("long").alias("turn"))


def file_groups(spark, folder):
    rows = results.file_groups(_ranked_by_file(spark, folder).withColumn("position", F.struct("position", "id")), "position")
    return rows.select("path", F.col("first_position.position").cast("long").alias("first_position"), "hits", F.array_join("kinds", ",").alias("kinds"), F.array_join("names", ",").alias("names"))


def relative_scores(spark, folder):
    return results.relative_scores(_ranked_by_file(spark, folder), by=["language"]).select("id", "score", "margin")


def _judged(spark, folder):
    """Symbols of every file as results, with confidence by their match."""
    rows = _s(spark, folder).withColumn("similarity", F.lit(None).cast("double")).withColumn("m", scoring.match(BROAD))
    extraction = classify.extraction_of(F.col("fallback"), F.col("doc"))
    trust = classify.retrieval_trust(extraction, F.col("m.confidence"))
    return rows.select("id", F.col("m.confidence").alias("confidence"), trust.alias("retrieval_trust"), "similarity")


def strong_matches(spark, folder):
    rows = _judged(spark, folder)
    return rows.groupBy("confidence", "retrieval_trust", results.is_strong(F.col("confidence"), F.col("retrieval_trust")).alias("strong")).agg(F.count("*").alias("symbols"))


def result_quality(spark, folder):
    rows = plans.search(_s(spark, folder), open_index(spark, folder).relations, open_index(spark, folder).files, BROAD, index=_i(spark, folder))
    return results.quality(rows)


def search_diagnostics(spark, folder):
    return results.channel_counts(_merged(spark, folder, BROAD)).select("lexical_candidates", "concept_candidates", "semantic_candidates", "most_similar_id", F.round("similarity", 6).alias("similarity"))


def collapsed_documents(spark, folder):
    """Documents as results in path order; equal operational ones are shown once."""
    from loomindex.functions.text import snippet

    rows = _s(spark, folder).filter("language = 'markdown'").select("id", "path", "name", snippet(F.col("body")).alias("snippet"), F.lit("related").alias("confidence"), F.col("id").alias("position"))
    return results.collapse_documents(rows, CONCEPT).select("id")


def lookup(spark, folder):
    return plans.lookup(_s(spark, folder), open_index(spark, folder).relations, open_index(spark, folder).files, BROAD, index=_i(spark, folder))


def show_largest(spark, folder):
    """The shown form of every class body."""
    from loomindex.functions.text import body_summary

    return _s(spark, folder).filter("kind = 'class'").select("id", body_summary(F.col("body"))["mode"].alias("mode"), F.md5(body_summary(F.col("body"))["text"]).alias("text_md5"))


_B = f"WITH {q.SYMBOLS}"
_HYBRID = replace(BROAD, model=MODEL, provider=PROVIDER)
_RANKED = "r AS (SELECT id, path, kind, name, language, length(name)::DOUBLE AS distance, row_number() OVER (PARTITION BY language ORDER BY length(name), id) AS position FROM sym WHERE kind IN ('class', 'function'))"
_CASCADES = {"score_symbol": SYMBOL, "score_concept": BROAD, "score_snake": SNAKE, "score_qualified": QUALIFIED, "score_typed": TYPED}

QUERIES = {
    f.__name__: f
    for f in (
        postings_table, bm25_scores, bm25_phrase, bm25_topk, literal_search, exact_lookup, concept_path, semantic_matches, semantic_topk, merged_channels, hybrid_fusion, best_by_name,
        diversified, file_groups, relative_scores, strong_matches, result_quality, search_diagnostics, collapsed_documents, lookup, show_largest,
    )
}
QUERIES |= {name: _cascade(spec) for name, spec in _CASCADES.items()}
QUERIES |= {"place_scores": _places(BROAD), "place_scores_code": _places(CODE), "pool_symbol": _pool(SYMBOL), "pool_concept": _pool(BROAD), "pool_code": _pool(CODE), "pool_hybrid": _pool(BROAD, True)}
QUERIES |= {"search_symbol": _search(SYMBOL), "search_concept": _search(BROAD), "search_code": _search(CODE)}


def _rank_sql(cte, channel, columns):
    return f"{_B}, {cte} SELECT {columns} FROM {channel}"


_MERGED = f"{_B}, {sq.merged(_HYBRID)}"
_JUDGED = f"{_B}, j AS (SELECT id, {sq.match(BROAD)} AS m, {q.extraction('fallback', 'doc')} AS x FROM (SELECT *, NULL::DOUBLE AS similarity FROM sym)), t AS (SELECT m.confidence AS confidence, CASE WHEN x = 'fallback' OR m.confidence = 'fallback' THEN 'low' WHEN m.confidence = 'exact' THEN 'high' WHEN m.confidence = 'strong' THEN CASE WHEN x = 'parsed' THEN 'high' ELSE 'medium' END ELSE CASE WHEN x = 'parsed' THEN 'medium' ELSE 'low' END END AS retrieval_trust FROM j)"
_DIVERSE = """f AS (SELECT *, position = min(position) OVER (PARTITION BY language) AS first, count(*) OVER (PARTITION BY language) AS n FROM r),
g AS (SELECT *, row_number() OVER (PARTITION BY language, path, first ORDER BY position) AS round, min(position) OVER (PARTITION BY language, path, first) AS start FROM f),
h AS (SELECT language, id, row_number() OVER (PARTITION BY language ORDER BY CASE WHEN first OR n <= 50 THEN 0 ELSE round END, CASE WHEN first OR n <= 50 THEN 0 ELSE start END, position) AS turn FROM g)"""
_RUN = QuerySpec("run")
SQL = {
    "postings_table": f"{_B}, "
    + "t AS ("
    + " UNION ALL ".join(f"SELECT id, '{f}' AS field, unnest({sq.tokens(f)}) AS term FROM sym" for f in p.FIELDS)
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT id, 'content', unnest({sq.tokens(f)}) FROM sym" for f in p.CONTENT)
    + ") SELECT term, field, count(*) AS occurrences, count(DISTINCT id) AS symbols FROM t GROUP BY ALL",
    "bm25_scores": f"{_B}, {sq.bm25(CONCEPT)} SELECT id, round(raw_score, 6) AS raw_score FROM bm",
    "bm25_phrase": f"{_B}, {sq.bm25(SNAKE)} SELECT id, round(raw_score, 6) AS raw_score FROM bm",
    "bm25_topk": _rank_sql(sq.lexical(CONCEPT), "lex", "id, round(raw_score, 6) AS raw_score, lexical_rank"),
    "literal_search": f"{_B}, l AS ({sq.literal_matches(SYMBOL)}) SELECT id, raw_score, level, kind_order FROM l",
    "exact_lookup": f"{_B}, e AS ({sq.exact_matches(SNAKE)}) SELECT id, level FROM e",
    "concept_path": f"{_B}, e AS ({sq.concept_matches(PLACE)}) SELECT id, level FROM e",
    "semantic_matches": f"{_B}, {sq.similar(MODEL, PROVIDER)} SELECT id, round(similarity, 6) AS similarity FROM sim",
    "semantic_topk": _rank_sql(sq.semantic(replace(CONCEPT, model=MODEL, provider=PROVIDER)), "sem", "id, round(similarity, 6) AS similarity, semantic_rank"),
    "merged_channels": f"{_MERGED} SELECT id, round(raw_score, 6) AS raw_score, round(similarity, 6) AS similarity, lexical, concept, semantic, coalesce(lexical_rank, 0) AS lexical_rank, coalesce(concept_rank, 0) AS concept_rank, coalesce(semantic_rank, 0) AS semantic_rank FROM mer",
    "hybrid_fusion": f"{_MERGED} SELECT id, round({sq.fusion()}, 6) AS score, array_to_string(list_filter([CASE WHEN lexical THEN 'lexical' END, CASE WHEN concept THEN 'concept_path' END, CASE WHEN semantic THEN 'semantic' END], lambda x: x IS NOT NULL), ',') AS channels,"
    " CASE WHEN NOT semantic THEN 'lexical_only' WHEN lexical OR concept THEN 'semantic_assisted' ELSE 'semantic_only' END AS contribution FROM mer",
    "best_by_name": f"{_B}, e AS ({sq.exact_matches(_RUN)}), top AS (SELECT * FROM e ORDER BY level, {q.kind_order(['class', 'module', 'method', 'function'])}, start_line, id LIMIT 50),"
    f" m AS (SELECT *, {sq.match(_RUN)} AS m FROM (SELECT *, NULL::DOUBLE AS similarity FROM top)), z AS (SELECT id, start_line, m, m.adjustment + {sq.kind_score()} + {sq.path_score(_RUN)} AS adjusted FROM m)"
    " SELECT id, round(adjusted, 6) AS adjusted, m.reason AS reason, m.confidence AS confidence FROM z ORDER BY z.adjusted, start_line, id LIMIT 10",
    "diversified": f"{_B}, {_RANKED}, {_DIVERSE} SELECT * FROM h WHERE turn <= 50",
    "file_groups": f"{_B}, {_RANKED}, k AS (SELECT path, kind, min((position, id)) AS p FROM r GROUP BY ALL), n AS (SELECT path, name, min((position, id)) AS p FROM r GROUP BY ALL) SELECT path, min(position) AS first_position, count(*) AS hits,"
    " (SELECT array_to_string(list_slice(list(kind ORDER BY p), 1, 3), ',') FROM k WHERE k.path = r.path) AS kinds, (SELECT array_to_string(list_slice(list(name ORDER BY p), 1, 3), ',') FROM n WHERE n.path = r.path) AS names FROM r GROUP BY path",
    "relative_scores": f"{_B}, {_RANKED}, m AS (SELECT id, CASE WHEN max(distance) OVER w > min(distance) OVER w THEN (distance - min(distance) OVER w) / (max(distance) OVER w - min(distance) OVER w) ELSE 0 END AS m FROM r WINDOW w AS (PARTITION BY language))"
    " SELECT id, floor((1 - m) * 1000 + 0.5) / 1000 AS score, floor(m * 1000 + 0.5) / 1000 AS margin FROM m",
    "strong_matches": f"{_JUDGED} SELECT confidence, retrieval_trust, confidence = 'exact' OR (confidence = 'strong' AND retrieval_trust <> 'low') AS strong, count(*) AS symbols FROM t GROUP BY ALL",
    "search_diagnostics": f"{_MERGED} SELECT count_if(lexical)::BIGINT AS lexical_candidates, count_if(concept)::BIGINT AS concept_candidates, count_if(semantic)::BIGINT AS semantic_candidates, arg_max(id, (similarity, -id)) FILTER (similarity IS NOT NULL) AS most_similar_id, round(max(similarity), 6) AS similarity FROM mer",
    "collapsed_documents": f"{_B}, d AS (SELECT id, CASE WHEN {q.is_operational('path')} THEN {q.key('name')} || '|' || substr({q.key(q.snippet('body'))}, 1, 120) END AS k FROM sym WHERE language = 'markdown') SELECT id FROM d QUALIFY k IS NULL OR row_number() OVER (PARTITION BY k ORDER BY id) = 1",
    "place_scores": f"{_B} SELECT id, round({sq.kind_score()}, 6) AS kind_score, round({sq.path_score(BROAD)}, 6) AS path_score FROM sym",
    "place_scores_code": f"{_B} SELECT id, round({sq.kind_score()}, 6) AS kind_score, round({sq.path_score(CODE)}, 6) AS path_score FROM sym",
}
SQL |= {name: f"{_B}, x AS (SELECT id, {sq.match(spec)} AS m FROM (SELECT *, NULL::DOUBLE AS similarity FROM sym)) SELECT id, round(m.adjustment, 6) AS adjustment, m.reason AS reason, m.confidence AS confidence FROM x" for name, spec in _CASCADES.items()}
SQL |= {
    name: f"{_B}, {sq.pool(spec)} SELECT id, reason, confidence, round(adjusted, 6) AS adjusted FROM pool"
    for name, spec in (("pool_symbol", SYMBOL), ("pool_concept", BROAD), ("pool_code", CODE), ("pool_hybrid", _HYBRID))
}
_FOUND = f"WITH {q.SYMBOLS}, {q.RELATIONS}, {q.FILES}"
for _name, _spec in (("search_symbol", SYMBOL), ("search_concept", BROAD), ("search_code", CODE)):
    _wide = replace(_spec, limit=max(3 * _spec.limit, _spec.limit + 4))
    SQL[_name] = (
        f"{_FOUND}, {sq.search(_wide, gq.POOL_SUPPORT)}, {sq.turns(_spec.limit)} SELECT turn, id, path, kind, name, confidence, reason, retrieval_trust, round(distance, 6) AS distance, score, margin, signals"
        f" FROM turned WHERE turn <= {_spec.limit}"
    )
_BEST = sq.search(BROAD, gq.POOL_SUPPORT)
_STRONG = "(confidence = 'exact' OR (confidence = 'strong' AND retrieval_trust <> 'low'))"
SQL |= {
    "lookup": f"{gq.walk(5, True)}, {_BEST} SELECT id, CASE WHEN position = 1 THEN 'match' ELSE 'alternative' END AS role, position AS place FROM found"
    " UNION ALL SELECT neighbour_id, traversal, place FROM placed WHERE id = (SELECT id FROM found WHERE position = 1)",
    # No vector in this query, so no result is confirmed by similarity.
    "result_quality": f"{_FOUND}, {_BEST}, a AS (SELECT count(*) AS results, count_if({_STRONG})::BIGINT AS strong_matches, bool_or({_STRONG} AND position = 1) AS first_strong,"
    " bool_or(position = 1 AND ((confidence = 'related' AND retrieval_trust <> 'low') OR confidence = 'strong')) AS usable FROM found),"
    " v AS (SELECT *, CASE WHEN results = 0 THEN 0 WHEN first_strong THEN 1 WHEN strong_matches > 0 THEN 2 WHEN usable THEN 3 ELSE 4 END AS v FROM a)"
    " SELECT CASE v WHEN 0 THEN 'none' WHEN 1 THEN 'strong' WHEN 4 THEN 'weak' ELSE 'moderate' END AS level, CASE v WHEN 0 THEN 'no_results' WHEN 1 THEN 'top_result_strong' WHEN 2 THEN 'strong_match_present' WHEN 3 THEN 'related_but_actionable'"
    " ELSE 'only_weak_matches' END AS reason, v IN (0, 3, 4) AS no_strong_match, results, strong_matches FROM v",
    "show_largest": f"{_B}, c AS (SELECT id, body, len(string_split(body, chr(10))) > 40 OR length(body) > 4000 AS long, array_to_string(list_slice(string_split(body, chr(10)), 1, 40), chr(10)) AS head FROM sym WHERE kind = 'class')"
    " SELECT id, CASE WHEN long THEN 'summary' WHEN body IS NOT NULL THEN 'full' END AS mode, md5(CASE WHEN NOT long THEN body WHEN length(head) > 4000 THEN substr(head, 1, 3997) || '...' ELSE head END) AS text_md5 FROM c",
}
