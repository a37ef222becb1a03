"""Changes of files and symbols, stored vectors, sequences of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomindex.operators import changes as ch
from loomindex.queries import sqltext as q
from loomindex.plans.opened import open_index
from loomindex.sources import tables

FLOW, ASIDE = ["view", "click", "purchase"], ["signup", "error"]
CUT = "2025-04-01"


def _states(spark, folder):
    """Files as they are now (newest state, deletions applied) and as they were indexed (oldest state, and what was seen since)."""
    rows = tables.table(spark, folder, "files").filter("path is not null").select("path", "size", "mtime_ms")
    was = rows.groupBy("path").agg(F.min(F.struct("mtime_ms", "size")).alias("f")).select("path", "f.size", "f.mtime_ms")
    seen = tables.table(spark, folder, "file_changes").filter("path is not null")
    newest = seen.groupBy("path").agg(F.max(F.struct("seen_at", "change_id", "change_kind")).alias("c")).select("path", "c.change_kind")
    now = open_index(spark, folder).files.join(newest.filter("change_kind = 'deleted'"), "path", "left_anti")
    return now, was.join(newest.filter("change_kind = 'new'"), "path", "left_anti")


def file_diff(spark, folder):
    return ch.file_diff(*_states(spark, folder))


def change_summary(spark, folder):
    rows = ch.change_summary(file_diff(spark, folder))
    return rows.select("change", "files", F.array_join("paths", ",").alias("paths"), "truncated")


def freshness(spark, folder):
    return ch.freshness(file_diff(spark, folder))


def index_merge(spark, folder):
    """Stored symbols of untouched files with those of changed files read again (here: from the same table)."""
    s = open_index(spark, folder).symbols
    merged = ch.merge_rows(s.withColumn("version", F.lit(1)), s.withColumn("version", F.lit(2)), file_diff(spark, folder))
    return merged.groupBy("language", "version").agg(F.count("*").alias("symbols"))


def _halves(spark, folder):
    rows = tables.table(spark, folder, "symbols").filter("id is not null")
    return rows.filter(F.col("indexed_at") < F.lit(CUT).cast("timestamp_ntz")), rows.filter(F.col("indexed_at") >= F.lit(CUT).cast("timestamp_ntz"))


def symbol_diff(spark, folder):
    """Identities indexed before and after a day."""
    return ch.symbol_diff(*_halves(spark, folder))


def symbol_change_samples(spark, folder):
    rows = ch.symbol_change_samples(symbol_diff(spark, folder))
    return rows.select("change", "symbols", F.array_join("names", ",").alias("names"))


def embedding_totals(spark, folder):
    e = tables.embeddings(spark, folder)
    return e.groupBy("provider", "model").agg(F.count("*").alias("vectors"), F.countDistinct("symbol_id").alias("symbols"))


def embedding_counts(spark, folder):
    """Vectors per file."""
    e = tables.embeddings(spark, folder).select("symbol_id")
    s = open_index(spark, folder).symbols.select(F.col("id").alias("symbol_id"), "path")
    return e.join(s, "symbol_id").groupBy("path").agg(F.count("*").alias("vectors"))


def replaced_vectors(spark, folder):
    """Vectors of one provider take the place of all vectors of their symbols."""
    e = tables.embeddings(spark, folder)
    merged = ch.replace_vectors(e, e.filter("provider = 'batch-runner'"))
    return merged.groupBy("provider").agg(F.count("*").alias("vectors"))


def _events(spark, folder):
    return tables.table(spark, folder, "events")


def event_transitions(spark, folder):
    return ch.transitions(_events(spark, folder), FLOW)


def event_impact(spark, folder):
    return ch.impact(_events(spark, folder), FLOW, ASIDE)


def session_events(spark, folder):
    s = ch.sessions(_events(spark, folder))
    return s.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "events", "total")


def windowed_events(spark, folder):
    w = ch.windowed(_events(spark, folder))
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "events", "total")


_DIFF = f"""WITH {q.FILES}, old AS (SELECT path, arg_min(size, (mtime_ms, coalesce(size, -1))) AS size, min(mtime_ms) AS mtime_ms FROM files WHERE path IS NOT NULL GROUP BY path),
seen AS (SELECT path, arg_max(change_kind, (seen_at, change_id)) AS kind FROM file_changes WHERE path IS NOT NULL GROUP BY path),
a AS (SELECT path, size, mtime_ms, true AS there FROM fil WHERE path NOT IN (SELECT path FROM seen WHERE kind = 'deleted')), b AS (SELECT path, size, mtime_ms, true AS there FROM old WHERE path NOT IN (SELECT path FROM seen WHERE kind = 'new')),
d AS (SELECT path, CASE WHEN b.there IS NULL THEN 'new' WHEN a.there IS NULL THEN 'deleted' WHEN a.size IS DISTINCT FROM b.size OR abs(coalesce(a.mtime_ms, 0) - coalesce(b.mtime_ms, 0)) > 10 THEN 'changed' END AS change FROM a FULL JOIN b USING (path)),
diff AS (SELECT * FROM d WHERE change IS NOT NULL)"""
_SYM_DIFF = f"""WITH rows AS (SELECT path, kind, name, coalesce(signature, '') AS signature, id, indexed_at < TIMESTAMP '{CUT}' AS old, (language, body, doc, fallback, start_line, start_column, end_line, end_column)::VARCHAR AS mark FROM symbols WHERE id IS NOT NULL),
w AS (SELECT path, kind, name, signature, arg_max(mark, id) FILTER (old) AS was, arg_max(mark, id) FILTER (NOT old) AS now FROM rows GROUP BY ALL),
diff AS (SELECT path, kind, name, signature, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN was <> now THEN 'changed' END AS change FROM w)"""
_CHAIN = f"""WITH f AS (SELECT event_id, user_id, event_type, ts, lag(event_type) OVER w AS p, lag(ts) OVER w AS t FROM events WHERE event_type IN {q.quoted(FLOW)} AND user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, CASE WHEN ts <= t + INTERVAL 30 MINUTE THEN p END AS previous FROM f)"""
_EMB = "WITH e AS (SELECT DISTINCT symbol_id, provider, model, dimensions, embedding FROM symbol_embeddings)"
_VERSION = "CASE WHEN diff.path IS NULL THEN 1 ELSE 2 END"

QUERIES = {
    f.__name__: f
    for f in (
        file_diff, change_summary, freshness, index_merge, symbol_diff, symbol_change_samples, embedding_totals, embedding_counts, replaced_vectors, event_transitions, event_impact, session_events, windowed_events,
    )
}
SQL = {
    "file_diff": f"{_DIFF} SELECT * FROM diff",
    "change_summary": f"{_DIFF} SELECT change, count(*) AS files, array_to_string(list_slice(list(path ORDER BY path), 1, 10), ',') AS paths, count(*) > 10 AS truncated FROM diff GROUP BY 1",
    "freshness": f"{_DIFF} SELECT count_if(change = 'new')::BIGINT AS new, count_if(change = 'changed')::BIGINT AS changed, count_if(change = 'deleted')::BIGINT AS deleted, count(*) > 0 AS stale FROM diff",
    "index_merge": f"{_DIFF}, {q.SYMBOLS} SELECT language, ({_VERSION})::INTEGER AS version, count(*) AS symbols FROM sym LEFT JOIN diff USING (path) WHERE diff.path IS NULL OR change <> 'deleted' GROUP BY ALL",
    "symbol_diff": f"{_SYM_DIFF} SELECT * FROM diff WHERE change IS NOT NULL",
    "symbol_change_samples": f"{_SYM_DIFF} SELECT change, count(*) AS symbols, array_to_string(list_slice(list(DISTINCT name ORDER BY name), 1, 20), ',') AS names FROM diff WHERE change IS NOT NULL GROUP BY 1",
    "embedding_totals": f"{_EMB} SELECT provider, model, count(*) AS vectors, count(DISTINCT symbol_id) AS symbols FROM e GROUP BY ALL",
    "embedding_counts": f"{_EMB}, {q.SYMBOLS} SELECT path, count(*) AS vectors FROM e JOIN sym ON sym.id = e.symbol_id GROUP BY 1",
    "replaced_vectors": f"{_EMB}, b AS (SELECT * FROM e WHERE provider = 'batch-runner'), m AS (SELECT * FROM e WHERE symbol_id NOT IN (SELECT symbol_id FROM b) UNION ALL SELECT * FROM b WHERE embedding IS NOT NULL AND len(embedding) > 0) SELECT provider, count(*) AS vectors FROM m GROUP BY 1",
    "event_transitions": f"{_CHAIN} SELECT previous, event_type, count(*) AS transitions, count(DISTINCT user_id) AS users FROM c WHERE previous IS NOT NULL GROUP BY ALL",
    "event_impact": f"{_CHAIN} SELECT count(*) AS flow_events, count(previous) AS chained_events, count_if(previous = event_type)::BIGINT AS repeats, count_if(event_type = 'purchase' AND previous <> 'purchase')::BIGINT AS completed, (SELECT count(*) FROM events WHERE event_type IN {q.quoted(ASIDE)}) AS beside_events FROM c",
    "session_events": "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)"
    " SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events, round(sum(coalesce(value, 0)), 4) AS total FROM n GROUP BY user_id, s",
    "windowed_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events, round(sum(coalesce(value, 0)), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL",
}
