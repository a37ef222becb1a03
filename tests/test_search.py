import math

import pytest
from pyspark.sql import functions as F

from loomindex.operators import candidates, graph, postings, results, scoring
from loomindex.plans import search as plans
from loomindex.plans.spec import QuerySpec
from tests.helpers import files, relations, rows, symbols


@pytest.fixture(scope="module")
def corpus(spark):
    return symbols(
        spark,
        [
            {"name": "queue_result", "signature": "queue_result(item)", "body": "queue result now", "path": "src/queue.py"},
            {"name": "other", "body": "result of the queue", "doc": "für", "path": "lib/other.py"},
            {"name": "Queue", "kind": "class", "signature": "class Queue", "body": "class Queue:\n  pass", "path": "src/queue.py", "end_line": 9},
            {"name": "Notes", "kind": "heading", "language": "markdown", "body": "# Notes", "path": "docs/notes.md"},
            {"name": "thing", "body": "", "path": "tests/thing.py"},
        ],
    ).cache()


def test_bm25_matches_the_formula(spark, corpus):
    got = {r.id: r.raw_score for r in postings.bm25(corpus, [("queue", "result")]).collect()}
    assert set(got) == {1}  # a phrase needs its tokens next to one another
    lengths = {r.id: r.n for r in postings.postings(corpus).groupBy("symbol_id").agg(F.count("*").alias("n")).withColumnRenamed("symbol_id", "id").collect()}
    n, mean, f = 5, sum(lengths.values()) / 5, 6  # name, signature and body, each also in content
    expected = -math.log((n - 1 + 0.5) / 1.5) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lengths[1] / mean))
    assert got[1] == pytest.approx(expected, abs=1e-6)


def test_common_terms_have_a_floor(spark):
    s = symbols(spark, [{"name": f"word{i}", "body": "common"} for i in range(5)])
    assert all(-1e-5 < r.raw_score < 0 for r in postings.bm25(s, [("common",)]).collect())
    assert postings.bm25(s.limit(0), [("common",)]).collect() == []
    assert postings.bm25(s, []).collect() == []


def test_folding_finds_accents(corpus):
    assert rows(postings.bm25(corpus, [("fur",)]), "id") == [(2,)]


def test_exact_levels_and_literal_fallback(corpus):
    found = dict(rows(candidates.exact_matches(corpus, QuerySpec("Queue")), "id", "level"))
    assert found == {3: 0}
    assert rows(candidates.literal_matches(corpus, QuerySpec("queue:result")), "id") == [(1,)]
    odd = QuerySpec("%$_!")
    assert candidates.candidates(corpus, odd).count() == 0


def test_merge_takes_the_best_of_each_channel(spark):
    s = symbols(spark, [{}])
    a = candidates._channel(s, raw_score=F.lit(-1.0), lexical=F.lit(True), lexical_rank=F.lit(4))
    b = candidates._channel(s, raw_score=F.lit(-3.0), semantic=F.lit(True), semantic_rank=F.lit(2), similarity=F.lit(0.7))
    row = candidates.merged([a, b, a]).first()
    assert (row.raw_score, row.similarity, row.lexical, row.concept, row.semantic, row.lexical_rank, row.semantic_rank) == (-3.0, 0.7, True, False, True, 4, 2)


def test_qualified_names(spark):
    s = symbols(
        spark,
        [
            {"name": "Student", "kind": "class", "signature": "class Sis::V2::Student", "language": "ruby"},
            {"name": "student", "kind": "method", "signature": "Sis::V2::Student#student", "language": "ruby"},
        ],
    ).withColumn("similarity", F.lit(None).cast("double"))
    m = {r.id: r.m for r in s.select("id", scoring.match(QuerySpec("Sis::V2::Student")).alias("m")).collect()}
    assert (m[1].reason, m[1].confidence) == ("signature_text", "exact")
    assert (m[2].adjustment, m[2].confidence) == (1.25, "related")


def test_search_ranks_definitions_and_scores_lie_in_range(spark, corpus):
    r = relations(spark, [{"source_path": "lib/other.py", "target_path": "src/queue.py", "relation_kind": "imports"}])
    f = files(spark, [("src/queue.py", "python", 1, 1.0)])
    found = plans.query(corpus, r, f, QuerySpec("Queue")).orderBy("turn").collect()
    assert found[0].name == "Queue" and found[0].score == 1.0
    assert all(0 <= x.score <= 1 and 0 <= x.margin <= 1 for x in found)
    assert plans.query(corpus, r, f, QuerySpec("nothingatall")).count() == 0
    fewer = plans.query(corpus, r, f, QuerySpec("Queue", limit=1)).collect()
    assert [x.id for x in fewer] == [found[0].id]


def test_order_of_rows_does_not_matter(spark, corpus):
    spec = QuerySpec("queue result")
    a = rows(plans.pool(corpus, spec), "id", "adjusted")
    assert a == rows(plans.pool(corpus.orderBy(F.desc("id")).repartition(3), spec), "id", "adjusted")


def test_lookup_show_graph_status(spark, corpus):
    r = relations(spark, [{"source_symbol_id": 1, "source_path": "src/queue.py", "target_path": "lib/other.py", "target_label": "lib.other"}])
    f = files(spark, [("src/queue.py", "python", 1, 1.0)])
    found = plans.lookup(corpus, r, f, QuerySpec("queue_result")).collect()
    assert {x.role for x in found} >= {"match", "uses"}
    assert plans.show(corpus, [1], full=True).first().text == "queue result now"
    assert plans.show(corpus, []).count() == 0
    assert plans.graph_around(corpus, r, [1]).first().uses == [2]
    assert dict(rows(plans.status(corpus, f), "language", "symbols")) == {"markdown": 1, "python": 4}
    assert plans.best_by_name(corpus, "queue").first().id == 3


def test_diversify(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "a", 3), (4, "b", 4), (5, "c", 5)], "id int, path string, position int")
    assert [r.id for r in results.diversify(df, 4).orderBy("turn").collect()] == [1, 2, 4, 5]
    assert [r.id for r in results.diversify(df, 9).orderBy("turn").collect()] == [1, 2, 3, 4, 5]


def test_quality_ladder(spark):
    schema = "position int, confidence string, retrieval_trust string, similarity double, margin double, contribution string"
    level = lambda *r: results.quality(spark.createDataFrame(list(r), schema)).first()
    assert level().level == "none"
    assert level((1, "exact", "high", None, 0.0, "lexical_only")).reason == "top_result_strong"
    assert level((1, "related", "high", 0.8, 0.2, "semantic_assisted")).reason == "top_result_semantically_confirmed"
    assert level((1, "related", "low", None, 0.0, "lexical_only"), (2, "exact", "high", None, 1.0, "lexical_only")).level == "moderate"
    assert level((1, "related", "medium", None, 0.0, "lexical_only")).no_strong_match
    assert level((1, "fallback", "low", None, 0.0, "lexical_only")).level == "weak"


def test_graph_edges(spark):
    s = symbols(spark, [{"name": "main", "path": "a.py"}, {"name": "helper", "path": "b.py"}, {"name": "alone", "path": "c.py"}, {"name": "inner", "path": "a.py", "start_line": 2, "end_line": 2, "start_column": 2}])
    s = s.withColumn("end_line", F.when(F.col("name") == "main", 9).otherwise(F.col("end_line")))
    r = relations(spark, [{"source_symbol_id": 1, "source_path": "a.py", "target_path": "b.py", "target_label": "b.helper"}, {"source_symbol_id": 1, "source_path": "a.py", "target_path": "b.py", "target_label": "b.helper"}, {"source_path": "a.py", "target_path": None}])
    d = {x.name: x for x in graph.diagnostics(s, r).collect()}
    assert d["helper"].inbound == 1 and d["main"].outbound == 1 and d["main"].root_like and d["alone"].possible_orphan and not d["helper"].possible_orphan
    assert rows(graph.possible_orphans(s, r), "name") == [("alone",), ("inner",)]
    assert rows(graph.containers(s), "id", "container_id") == [(4, 1)]
    walked = rows(graph.traversal(s, r, s), "id", "traversal", "neighbour_id")
    assert walked == [(1, "uses", 2), (2, "used_by", 1)]
    assert graph.traversal(s, r.limit(0), s).count() == 0
