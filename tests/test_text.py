from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomindex.functions import classify, text
from loomindex.plans.spec import QuerySpec, lookup_key, stem
from loomindex.sources.tables import once


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_names_and_stems(spark):
    assert one(spark, text.name_parts(F.col("a")), a="parseHTTPRequest_fast") == ["parse", "http", "request", "fast"]
    assert one(spark, text.lookup_key(F.col("a")), a="Queue-Result_2!") == "queueresult2"
    for word in ("stories", "classes", "class", "running", "ring", "bus", "maps", "ties"):
        assert one(spark, text.stem(F.col("a")), a=word) == stem(word)
    assert one(spark, text.name_parts(F.lit(None).cast("string"))) == []


def test_snippets_and_summaries(spark):
    assert one(spark, text.snippet(F.col("a")), a="a\n  b ") == "a b"
    assert one(spark, text.snippet(F.col("a")), a="x" * 500) == "x" * 197 + "..."
    long = "\n".join(f"line {i}" for i in range(100))
    s = one(spark, text.body_summary(F.col("a")), a=long)
    assert (s.mode, s.total_lines, s.shown_lines) == ("summary", 100, 40) and s.text == "\n".join(long.split("\n")[:40])
    assert one(spark, text.body_summary(F.col("a")), a="x").mode == "full"


def test_cosine(spark):
    arrays = lambda a, b: text.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))
    assert one(spark, arrays([1.0, 0.0], [1.0, 0.0, 5.0])) == 1.0
    assert one(spark, arrays([0.0, 0.0], [1.0, 0.0])) == 0.0
    assert one(spark, text.cosine(F.array().cast("array<double>"), F.array(F.lit(1.0)))) == 0.0


def test_folded_tokens(spark):
    assert one(spark, text.search_tokens(F.col("a")), a="Für my_name, ÉTÉ!") == ["fur", "my", "name", "ete"]


def test_paths(spark):
    p = F.col("p")
    assert one(spark, classify.is_test_path(p), p="src/testing/a.py") and not one(spark, classify.is_test_path(p), p="test_x.py")
    assert one(spark, classify.matches_any(p, []), p="a") and not one(spark, classify.matches_any(p, ["  "]), p="a")
    assert not one(spark, classify.matches_none(p, ["SRC\\"]), p="src/a")
    assert one(spark, classify.detected_language(p), p="x/Dockerfile.dev") == "dockerfile"
    assert one(spark, classify.detected_language(p), p="x/a.TSX") == "typescript"
    assert one(spark, classify.detected_language(p), p="x/README") is None
    assert one(spark, classify.looks_like_shell(p), p="#!/bin/bash\n") and not one(spark, classify.looks_like_shell(p), p="just a note\nof two lines")


def test_once_counts_repeated_rows_once(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None)], "id int, x string")
    assert sorted(map(tuple, once(df, "id").collect())) == [(1, "a"), (2, None)]


@given(st.text())
def test_lookup_key_is_idempotent(s):
    assert lookup_key(lookup_key(s)) == lookup_key(s)


def test_query_facts():
    assert QuerySpec("mergeKey").is_symbol and not QuerySpec("merge").is_symbol
    assert QuerySpec("'A::B::run'").variants == ["'A::B::run'", "A::B::run", "run'", "run"]
    assert QuerySpec("build_message here").phrases == [("build", "message"), ("here",), ("buildmessagehere",)]
    assert QuerySpec("functions that take an account").typed_terms == ["function", "that", "account"]
    for bad in ({"text": " "}, {"text": "x", "limit": 0}, {"text": "x", "docs_only": True, "code_only": True}):
        try:
            QuerySpec(**bad)
        except ValueError:
            continue
        raise AssertionError(bad)
