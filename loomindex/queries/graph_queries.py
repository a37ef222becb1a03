"""Queries over the relation graph of the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomindex.functions import classify
from loomindex.operators import graph
from loomindex.queries import sqltext as q
from loomindex.plans.opened import open_index
from loomindex.sources import tables


def _s(spark, folder):
    return open_index(spark, folder).symbols


def _r(spark, folder):
    return open_index(spark, folder).relations


def _modules(spark, folder):
    """A large candidate set: all classes and functions."""
    return _s(spark, folder).filter("kind in ('class', 'function')").select("id", "path", "kind", "language")


def contained_edges(spark, folder):
    return graph.contained_edges(_s(spark, folder)).groupBy("target_path").agg(F.count("*").alias("symbols"))


def neighbourhood_edges(spark, folder):
    return graph.neighbourhood(_r(spark, folder), _modules(spark, folder))


def graph_support(spark, folder):
    found = graph.graph_support(_modules(spark, folder), _r(spark, folder), graph.likely_roots(open_index(spark, folder).files, _s(spark, folder)))
    return found.select("id", F.round("graph_score", 6).alias("graph_score"), F.array_join("signals", ",").alias("signals"))


def symbol_relations(spark, folder):
    return graph.relations_of(_s(spark, folder), _r(spark, folder))


def inbound_relations(spark, folder):
    return graph.inbound_of(_s(spark, folder), _r(spark, folder))


def target_candidates(spark, folder):
    edges = _r(spark, folder).filter("relation_kind <> 'contained_in'")
    return graph.neighbours_in(edges, _s(spark, folder), "target_path", False).select("target_path", "target_label", "neighbour_id", F.col("place").cast("long").alias("place"))


def source_candidates(spark, folder):
    edges = _r(spark, folder).filter("relation_kind <> 'contained_in'")
    return graph.neighbours_in(edges, _s(spark, folder), "source_path", True).select("source_path", "target_label", "neighbour_id", F.col("place").cast("long").alias("place"))


def containers(spark, folder):
    return graph.containers(_s(spark, folder)).withColumn("place", F.col("place").cast("long"))


def _traversal(spark, folder, limit, inbound=True):
    s = _s(spark, folder)
    return graph.traversal(s, _r(spark, folder), s.select("id", "path", "start_line", "start_column", "end_line", "end_column"), limit, inbound)


def related_symbols(spark, folder):
    return _traversal(spark, folder, 5, False).withColumn("place", F.col("place").cast("long"))


def traversal(spark, folder):
    return _traversal(spark, folder, 5).withColumn("place", F.col("place").cast("long"))


def traversal_groups(spark, folder):
    groups = graph.traversal_groups(_traversal(spark, folder, 20))
    return groups.select("id", *[F.array_join(c, ",").alias(c) for c in ("imports", "uses", "contained_in", "imported_by", "used_by")])


def graph_diagnostics(spark, folder):
    d = graph.diagnostics(_s(spark, folder), _r(spark, folder))
    flags = ["tests_only", "same_file_only", "root_like", "disconnected", "possible_orphan"]
    return d.select("id", "inbound", "outbound", *flags, *[F.array_join(c, "; ").alias(c) for c in ("root_reasons", "orphan_reasons", "notes")])


def root_reasons(spark, folder):
    s = _s(spark, folder).filter("kind not in ('import', 'file')")
    return s.select("id", F.array_join(classify.root_reasons(F.col("path"), F.col("language"), F.array("name")), "; ").alias("reasons"))


def likely_roots(spark, folder):
    return graph.likely_roots(open_index(spark, folder).files, _s(spark, folder)).select("path", "language", F.array_join("reasons", "; ").alias("reasons"))


def top_roots(spark, folder):
    """A report: the twelve files with most reasons."""
    return graph.top_roots(open_index(spark, folder).files, _s(spark, folder)).select("path", "language", F.array_join("reasons", "; ").alias("reasons"))


def possible_orphans(spark, folder):
    return graph.possible_orphans(_s(spark, folder), _r(spark, folder))


_BASE = f"WITH {q.SYMBOLS}, {q.RELATIONS}, {q.FILES}"
_NAMES = "(SELECT path, list(DISTINCT lower(name)) AS names FROM sym WHERE kind NOT IN ('import', 'file') AND start_line <= 160 AND lower(name) IN ('main', 'cli', 'run', 'startup') GROUP BY path)"
_ROOTS = f"roots AS (SELECT path, language, {q.root_reasons('path', 'language', 'coalesce(names, [])')} AS reasons FROM fil LEFT JOIN {_NAMES} USING (path))"
_MODULES = "c AS (SELECT id, path, kind, language FROM sym WHERE kind IN ('class', 'function'))"
_HOOD = (
    "code AS (SELECT * FROM c WHERE language <> 'markdown'),"
    " hood AS (SELECT DISTINCT relation_kind, source_path, target_path FROM rel WHERE relation_kind IN ('imports', 'uses') AND source_path IN (SELECT path FROM c) AND target_path IN (SELECT path FROM c))"
)
_COUNTS = ", ".join(f"{d}_{k} AS (SELECT {e}_path AS path, count(*) AS n FROM hood WHERE relation_kind = '{k}' GROUP BY 1)" for k in ("imports", "uses") for d, e in (("outgoing", "source"), ("incoming", "target")))
_DEF = q.is_definition("kind")
_SUPPORT = f"""
, same AS (SELECT path, count(*) AS n FROM code GROUP BY 1), {_ROOTS}, parts AS (
  SELECT code.id, kind, same.n - 1 AS a, coalesce(oi.n, 0) AS b, coalesce(ii.n, 0) AS c, coalesce(ou.n, 0) AS d, coalesce(iu.n, 0) AS e, CASE WHEN r.path IS NULL THEN 0 ELSE 1 END AS f
  FROM code JOIN same USING (path) LEFT JOIN outgoing_imports oi USING (path) LEFT JOIN incoming_imports ii USING (path) LEFT JOIN outgoing_uses ou USING (path) LEFT JOIN incoming_uses iu USING (path)
  LEFT JOIN (SELECT path FROM roots WHERE len(reasons) > 0) r USING (path)
), score AS (
  SELECT *, -(0.22::DOUBLE * least(a, 3) + 0.38::DOUBLE * least(b, 2) + CASE WHEN {_DEF} THEN 0.95::DOUBLE ELSE 0.5::DOUBLE END * least(c, 2) + 0.22::DOUBLE * least(d, 2)
    + CASE WHEN {_DEF} THEN 0.7::DOUBLE ELSE 0.35::DOUBLE END * least(e, 2) + CASE WHEN {_DEF} THEN 0.45::DOUBLE ELSE 0.2::DOUBLE END * f) AS g FROM parts
)
SELECT id, round(CASE WHEN kind = 'import' THEN g * 0.35 ELSE g END, 6) AS graph_score,
  array_to_string(list_filter([CASE WHEN a > 0 THEN 'same_file_cluster' END, CASE WHEN b > 0 THEN 'imports_candidate' END, CASE WHEN c > 0 THEN 'imported_by_candidate' END,
    CASE WHEN d > 0 THEN 'uses_candidate' END, CASE WHEN e > 0 THEN 'used_by_candidate' END, CASE WHEN f > 0 THEN 'root_candidate' END], lambda x: x IS NOT NULL), ',') AS signals
FROM score WHERE a + b + c + d + e + f > 0"""
#: Support of the rows of ``pool`` for a query that does not ask for entry points: CTE ``support`` (id, graph_score, signals).
POOL_SUPPORT = (
    f"c AS (SELECT id, path, kind, language FROM pool), {_HOOD}, {_COUNTS}"
    + _SUPPORT.replace(f"{_ROOTS}, ", "").replace("(SELECT path FROM roots WHERE len(reasons) > 0) r", "(SELECT path FROM fil WHERE false) r").replace("\nSELECT id, round(", ", support AS (SELECT id, round(")
    + ")"
)
_REL_OF = """
own AS (
  SELECT s.id, relation_kind, target_path, target_label FROM rel JOIN sym s ON s.id = rel.source_symbol_id
  UNION SELECT s.id, relation_kind, target_path, target_label FROM rel JOIN sym s ON s.path = rel.source_path WHERE relation_kind = 'imports'
)"""
_INBOUND = "inb AS (SELECT DISTINCT target_path AS path, relation_kind, source_path, target_label FROM rel WHERE relation_kind IN ('imports', 'uses') AND target_path IN (SELECT path FROM sym))"
_TAIL = "lower(trim(string_split_regex(target_label, '::|\\.')[-1]))"


def _near(name: str, edges: str, path: str, tests: list[str]) -> str:
    level = q.first_true([f"lower(name) = {_TAIL}", *[f"contains(lower(coalesce({c}, '')), {_TAIL})" for c in tests]])
    return (
        f"{name} AS (SELECT e.{path}, e.target_label, s.id AS neighbour_id, row_number() OVER (PARTITION BY e.{path}, e.target_label ORDER BY {level}, {q.kind_order(graph.NEIGHBOUR_KINDS)}, start_line, s.id) AS place"
        f" FROM (SELECT DISTINCT {path}, target_label FROM {edges}) e JOIN sym s ON s.path = e.{path} WHERE s.kind NOT IN ('import', 'file'))"
    )


_CONTAINERS = """cont AS (
  SELECT i.id, o.id AS container_id, row_number() OVER (PARTITION BY i.id ORDER BY (o.end_line - o.start_line) * 1000 + (o.end_column - o.start_column), o.start_line, o.id) AS place
  FROM sym i JOIN sym o ON i.path = o.path AND i.id <> o.id AND o.kind NOT IN ('import', 'file')
  WHERE (o.start_line < i.start_line OR (o.start_line = i.start_line AND o.start_column <= i.start_column)) AND (o.end_line > i.end_line OR (o.end_line = i.end_line AND o.end_column >= i.end_column))
)"""


def walk(limit: int, inbound: bool) -> str:
    back = (
        f" UNION ALL SELECT s.id, CASE i.relation_kind WHEN 'imports' THEN 'imported_by' ELSE 'used_by' END, i.source_path, i.target_label, n.neighbour_id, n.place, 1 FROM inb i JOIN sym s USING (path)"
        " JOIN near_in n ON n.source_path = i.source_path AND n.target_label IS NOT DISTINCT FROM i.target_label"
        if inbound
        else ""
    )
    order = "side, traversal, target_label NULLS FIRST, other_path NULLS FIRST, neighbour_id"
    return f"""{_BASE}, {_REL_OF}, {_INBOUND}, {_CONTAINERS}, {_near('near_out', 'rel', 'target_path', ['name'])}, {_near('near_in', 'rel', 'source_path', ['signature', 'body'])}, walk AS (
  SELECT o.id, o.relation_kind AS traversal, o.target_path AS other_path, o.target_label, n.neighbour_id, n.place, 0 AS side FROM own o
  JOIN near_out n ON n.target_path = o.target_path AND n.target_label IS NOT DISTINCT FROM o.target_label WHERE o.relation_kind <> 'contained_in'
  UNION ALL SELECT o.id, o.relation_kind, o.target_path, o.target_label, c.container_id, c.place, 0 FROM own o JOIN cont c USING (id) WHERE o.relation_kind = 'contained_in' AND c.place <= 3{back}
), best AS (SELECT * FROM walk WHERE neighbour_id <> id AND place <= 5 QUALIFY row_number() OVER (PARTITION BY id, side, traversal, other_path, target_label ORDER BY place) = 1),
once AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY id, traversal, neighbour_id ORDER BY {order}) = 1),
nth AS (SELECT id, traversal, neighbour_id, target_label, row_number() OVER (PARTITION BY id ORDER BY {order}) AS nth FROM once),
placed AS (SELECT id, traversal, neighbour_id, target_label, nth AS place FROM nth WHERE nth <= {limit})
"""


_DIAGNOSED = f"""{_BASE}, inb AS (
  SELECT target_path AS path, count(DISTINCT source_path) AS inbound, count(DISTINCT CASE WHEN source_path <> target_path THEN source_path END) AS inbound_other,
    count(DISTINCT CASE WHEN {q.is_test('source_path')} THEN source_path END) AS inbound_tests FROM rel WHERE relation_kind IN ('imports', 'uses') AND target_path IS NOT NULL GROUP BY 1
), edges AS (
  SELECT source_symbol_id AS id, source_path, target_path FROM rel WHERE source_symbol_id IS NOT NULL AND relation_kind IN ('imports', 'uses') AND target_path IS NOT NULL
  UNION ALL SELECT s.id, r.source_path, r.target_path FROM rel r JOIN sym s ON s.path = r.source_path WHERE r.relation_kind = 'imports' AND r.target_path IS NOT NULL
), outb AS (SELECT id, count(DISTINCT target_path) AS outbound, count(DISTINCT CASE WHEN target_path <> source_path THEN target_path END) AS outbound_other FROM edges GROUP BY 1
), d AS (
  SELECT s.id, s.path, s.language, s.kind, s.name, s.fallback, coalesce(inbound, 0) AS inbound, coalesce(inbound_other, 0) AS inbound_other, coalesce(inbound_tests, 0) AS inbound_tests, coalesce(outbound, 0) AS outbound,
    coalesce(outbound_other, 0) AS outbound_other, {q.root_reasons('s.path', 's.language', '[lower(s.name)]')} AS root FROM sym s LEFT JOIN inb ON inb.path = s.path LEFT JOIN outb ON outb.id = s.id
), e AS (
  SELECT *, len(root) > 0 AS root_like, inbound > 0 AND inbound_tests = inbound AS tests_only, inbound + outbound > 0 AND inbound_other + outbound_other = 0 AS same_file_only FROM d
), f AS (SELECT *, inbound = 0 AND outbound = 0 AND NOT root_like AS disconnected, inbound = 0 AND NOT root_like AND NOT same_file_only AS possible_orphan FROM e)
"""
_TEXTS = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), '; ')"
_NOTES = _TEXTS.format(
    "CASE WHEN inbound = 0 THEN 'no known inbound references' END, CASE WHEN tests_only THEN 'inbound references only from tests' END, CASE WHEN same_file_only THEN 'connected only within its file' END,"
    " CASE WHEN disconnected THEN 'neither inbound nor outbound references' END, CASE WHEN root_like THEN 'looks like an entry point' END"
)
_REASONS = "CASE WHEN possible_orphan THEN 'no known inbound references; not classified as a likely root' || CASE WHEN disconnected THEN '; disconnected from the indexed graph' ELSE '' END ELSE '' END"

QUERIES = {
    f.__name__: f
    for f in (
        contained_edges, neighbourhood_edges, graph_support, symbol_relations, inbound_relations, target_candidates, source_candidates, containers, related_symbols, traversal, traversal_groups,
        graph_diagnostics, root_reasons, likely_roots, top_roots, possible_orphans,
    )
}
SQL = {
    "contained_edges": f"{_BASE} SELECT path AS target_path, count(*) AS symbols FROM sym WHERE kind <> 'file' GROUP BY 1",
    "neighbourhood_edges": f"{_BASE}, {_MODULES}, {_HOOD} SELECT * FROM hood",
    "graph_support": f"{_BASE}, {_MODULES}, {_HOOD}, {_COUNTS} {_SUPPORT}",
    "symbol_relations": f"{_BASE}, {_REL_OF} SELECT * FROM own",
    "inbound_relations": f"{_BASE}, {_INBOUND} SELECT * FROM inb",
    "target_candidates": f"{_BASE}, e AS (SELECT * FROM rel WHERE relation_kind <> 'contained_in'), {_near('n', 'e', 'target_path', ['name'])} SELECT * FROM n WHERE place <= 5",
    "source_candidates": f"{_BASE}, e AS (SELECT * FROM rel WHERE relation_kind <> 'contained_in'), {_near('n', 'e', 'source_path', ['signature', 'body'])} SELECT * FROM n WHERE place <= 5",
    "containers": f"{_BASE}, {_CONTAINERS} SELECT * FROM cont WHERE place <= 3",
    "related_symbols": f"{walk(5, False)} SELECT * FROM placed",
    "traversal": f"{walk(5, True)} SELECT * FROM placed",
    "traversal_groups": f"{walk(20, True)} SELECT id, "
    + ", ".join(f"coalesce(string_agg(neighbour_id::VARCHAR, ',' ORDER BY place) FILTER (traversal = '{t}'), '') AS {t}" for t in ("imports", "uses", "contained_in", "imported_by", "used_by"))
    + " FROM placed GROUP BY id",
    "graph_diagnostics": f"{_DIAGNOSED} SELECT id, inbound, outbound, tests_only, same_file_only, root_like, disconnected, possible_orphan, array_to_string(root, '; ') AS root_reasons, {_REASONS} AS orphan_reasons, {_NOTES} AS notes FROM f",
    "root_reasons": f"{_BASE} SELECT id, array_to_string({q.root_reasons('path', 'language', '[lower(name)]')}, '; ') AS reasons FROM sym WHERE kind NOT IN ('import', 'file')",
    "likely_roots": f"{_BASE}, {_ROOTS} SELECT path, language, array_to_string(reasons, '; ') AS reasons FROM roots WHERE len(reasons) > 0",
    "top_roots": f"{_BASE}, {_ROOTS} SELECT path, language, array_to_string(reasons, '; ') AS reasons FROM roots WHERE len(reasons) > 0 ORDER BY len(reasons) DESC, path LIMIT 12",
    "possible_orphans": f"{_DIAGNOSED} SELECT id, path, language, kind, name, outbound FROM f WHERE possible_orphan AND NOT coalesce(fallback, false) AND language <> 'markdown' AND NOT {q.is_test('path')} AND {q.is_definition('kind')}",
}
