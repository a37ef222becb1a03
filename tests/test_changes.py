import datetime as dt

from loomindex.operators import changes as ch
from tests.helpers import files, rows, symbols


def test_file_diff_and_summary(spark):
    now = files(spark, [("a", "x", 1, 5.0), ("b", "x", 2, 100.0), ("c", "x", None, 1.0), ("new", "x", 1, 1.0)])
    then = files(spark, [("a", "x", 1, 14.0), ("b", "x", 2, 89.0), ("c", "x", 3, 1.0), ("old", "x", 1, 1.0)])
    diff = ch.file_diff(now, then)
    assert rows(diff) == [("b", "changed"), ("c", "changed"), ("new", "new"), ("old", "deleted")]
    s = {r.change: r for r in ch.change_summary(diff, 1).collect()}
    assert s["changed"].files == 2 and s["changed"].paths == ["b"] and s["changed"].truncated and not s["new"].truncated
    assert ch.freshness(diff).first().stale and not ch.freshness(diff.limit(0)).first().stale and ch.freshness(diff.limit(0), False).first().stale


def test_merge_is_idempotent(spark):
    stored = symbols(spark, [{"path": "a"}, {"path": "b"}, {"path": "c"}])
    fresh = symbols(spark, [{"id": 9, "path": "b"}, {"id": 8, "path": "z"}])
    diff = spark.createDataFrame([("b", "changed"), ("c", "deleted")], "path string, change string")
    once = ch.merge_rows(stored, fresh, diff)
    assert rows(once, "id", "path") == [(1, "a"), (9, "b")]
    assert rows(ch.merge_rows(once, fresh, diff), "id", "path") == rows(once, "id", "path")


def test_symbol_diff(spark):
    a = symbols(spark, [{"name": "x", "body": "1"}, {"name": "y"}, {"name": "w", "signature": None}])
    b = symbols(spark, [{"name": "x", "body": "0"}, {"name": "x", "body": "2"}, {"name": "z"}, {"name": "w", "signature": ""}])
    assert rows(ch.symbol_diff(a, b), "name", "change") == [("x", "changed"), ("y", "removed"), ("z", "added")]


def test_replaced_vectors(spark):
    schema = "symbol_id bigint, embedding array<double>"
    old = spark.createDataFrame([(1, [1.0]), (2, [2.0])], schema)
    new = spark.createDataFrame([(2, [3.0]), (3, []), (4, None)], schema)
    assert rows(ch.replace_vectors(old, new)) == [(1, [1.0]), (2, [3.0])]


def events(spark, data):
    at = lambda m: dt.datetime(2025, 1, 1) + dt.timedelta(minutes=m) if m is not None else None
    return spark.createDataFrame([(i, at(m), u, t, 1.0) for i, (m, u, t) in enumerate(data)], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")


EVENTS = [(0, 1, "view"), (5, 1, "error"), (10, 1, "click"), (45, 1, "purchase"), (46, 1, "purchase"), (0, 2, "view"), (None, 2, "click"), (3, None, "view")]


def test_chains(spark):
    e = events(spark, EVENTS)
    assert rows(ch.transitions(e, ["view", "click", "purchase"]), "previous", "event_type", "transitions") == [("purchase", "purchase", 1), ("view", "click", 1)]
    i = ch.impact(e, ["view", "click", "purchase"], ["error"]).first()
    assert (i.flow_events, i.chained_events, i.repeats, i.completed, i.beside_events) == (5, 2, 1, 0, 1)
    assert ch.transitions(e.limit(0), ["view"]).count() == 0


def test_stream_of_chains_equals_the_batch(spark, tmp_path):
    from loomindex.streaming.sequences import chained_stream

    flow = ["view", "click", "purchase"]
    e = events(spark, EVENTS)
    for i, part in enumerate((e.filter("event_id <= 2"), e.filter("event_id > 2"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = chained_stream(source, flow).writeStream.format("memory").queryName("chains").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = rows(spark.table("chains"), "event_id", "previous")
    assert dict(got) == dict(rows(ch.chained(e, flow), "event_id", "previous"))


def test_watch_replaces_by_path(spark, tmp_path):
    from loomindex.streaming.watch import PathTable, apply_batch, watch

    table = PathTable(spark, f"{tmp_path}/index", slots=4)
    assert table.read() is None
    table.write(symbols(spark, [{"path": "a"}, {"path": "b"}]).select("id", "path"))
    extract = lambda diff: diff.selectExpr("100L as id", "path")
    change = spark.createDataFrame([(1, "b", "deleted", dt.datetime(2025, 1, 2)), (2, "b", "new", dt.datetime(2025, 1, 1)), (3, "c", "new", dt.datetime(2025, 1, 1))], "change_id bigint, path string, change_kind string, seen_at timestamp_ntz")
    change.write.parquet(f"{tmp_path}/changes")
    stream = spark.readStream.schema(change.schema).parquet(f"{tmp_path}/changes")
    watch(stream, table, extract, f"{tmp_path}/check", once=True).awaitTermination()
    assert rows(table.read(), "id", "path") == [(1, "a"), (100, "c")]
    apply_batch(table, extract)(change, 0)  # the same batch again
    assert rows(table.read(), "id", "path") == [(1, "a"), (100, "c")]
    gone = spark.createDataFrame([("a", "deleted"), ("c", "deleted")], "path string, change string")
    table.replace(table.read().limit(0), gone)
    assert rows(table.read()) == []


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    from loomindex.streaming.watch import PathTable

    table = PathTable(spark, f"{tmp_path}/t", slots=8)
    table.write(spark.createDataFrame([(i, f"p{i}") for i in range(60)], "id bigint, path string"))
    before = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    table.replace(spark.createDataFrame([(99, "p3")], "id bigint, path string"), spark.createDataFrame([("p3", "changed")], "path string, change string"))
    after = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    assert len(before) == 8 and len(set(before.items()) & set(after.items())) == 7
    assert rows(table.read()) == sorted([(i, f"p{i}") for i in range(60) if i != 3] + [(99, "p3")])


def test_command_report(spark):
    at = lambda m: dt.datetime(2025, 1, 1, 10, 0) + dt.timedelta(minutes=m)
    log = [
        ("lookup", 0, "strong", None, True, False, None), ("show", 1, None, "full", None, None, None), ("query", 2, "weak", None, None, True, None), ("watch", 3, None, None, None, None, None), ("status", 4, None, None, None, None, None),
        ("query", 5, "moderate", None, None, None, None), ("graph", 6, None, None, None, None, True), ("lookup", 7, "weak", None, None, True, None), ("graph", 8, None, None, None, None, True), ("show", 60, None, "summary", None, None, None),
    ]
    rows_ = [(i, "p", at(m), c, 10, q, b, s, n, f) for i, (c, m, q, b, s, n, f) in enumerate(log)] + [(99, None, at(0), "query", 5, None, None, None, None, None), (98, "q", at(0), "watch", None, None, None, None, None, None)]
    e = spark.createDataFrame(rows_, "event_id bigint, project string, ts timestamp_ntz, command string, payload_chars bigint, result_quality string, body_mode string, selected_result boolean, no_strong_match boolean, full_requested boolean")
    got = {r.project: r.asDict() for r in ch.command_report(e).collect()}
    assert got["p"] == {
        "project": "p", "payload_chars": 90, "recorded_commands": 9, "infrastructure_commands": 1, "lookup_to_show": 1, "query_to_show": 0, "lookup_to_graph": 1, "query_to_graph": 1, "full_bodies": 1, "no_strong_match": 2,
        "one_shot_lookups": 1, "lookup_to_full_show": 1, "lookup_to_full_graph": 1, "weak_result_retry": 1, "graph_follow_ups": 2, "avoided_search_loops": 4, "avoided_file_reads": 2,
    }
    assert got["q"]["recorded_commands"] == 0 and got["q"]["infrastructure_commands"] == 1
    assert ch.command_report(e.limit(0)).count() == 0
