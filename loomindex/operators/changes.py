"""Change detection, incremental merge and symbol diffs; and sequences of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values. Clock jitter that is no change, in milliseconds; samples shown; gap that ends a chain.
JITTER_MS, SAMPLES, SYMBOL_SAMPLES, CHAIN_MINUTES = 10.0, 10, 20, 30
IDENTITY = ["path", "kind", "name", "signature"]
FINGERPRINT = ["language", "body", "doc", "fallback", "start_line", "start_column", "end_line", "end_column"]


def file_diff(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, change) of new, deleted and changed files. Both sides: one row per path with size and mtime_ms.

    A size that differs (null included) or a time that differs by more than the jitter is a change.
    """
    a = current.select("path", F.col("size").alias("size_now"), F.col("mtime_ms").alias("mtime_now"), F.lit(True).alias("now"))
    b = indexed.select("path", F.col("size").alias("size_then"), F.col("mtime_ms").alias("mtime_then"), F.lit(True).alias("then"))
    moved = F.abs(F.coalesce("mtime_now", F.lit(0.0)) - F.coalesce("mtime_then", F.lit(0.0))) > JITTER_MS
    changed = ~F.col("size_now").eqNullSafe(F.col("size_then")) | moved
    kind = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(changed, "changed")
    return a.join(b, "path", "full_outer").select("path", kind.alias("change")).filter("change is not null")


def change_summary(diff: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Per kind of change: number, the first paths, whether there are more. Only the samples are gathered."""
    placed = diff.withColumn("n", F.row_number().over(Window.partitionBy("change").orderBy("path"))).filter(F.col("n") <= samples)
    shown = placed.groupBy("change").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return diff.groupBy("change").agg(F.count("*").alias("files")).join(shown, "change").withColumn("truncated", F.col("files") > samples)


def freshness(diff: DataFrame, same_scope: bool = True) -> DataFrame:
    """One row: whether the index is stale, and the numbers of changes."""
    counts = [F.count(F.when(F.col("change") == c, 1)).alias(c) for c in ("new", "changed", "deleted")]
    return diff.agg(*counts).withColumn("stale", (F.col("new") + F.col("changed") + F.col("deleted") > 0) | F.lit(not same_scope))


def merge_rows(stored: DataFrame, fresh: DataFrame, diff: DataFrame) -> DataFrame:
    """The stored rows of untouched paths and the fresh rows of new and changed ones."""
    kept = stored.join(diff.select("path"), "path", "left_anti")
    added = fresh.join(diff.filter("change <> 'deleted'").select("path"), "path", "left_semi")
    return kept.unionByName(added.select(*kept.columns))


def replace_vectors(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Vectors of the given symbols take the place of stored ones; empty and null vectors are skipped."""
    good = fresh.filter("embedding is not null and size(embedding) > 0")
    return stored.join(fresh.select("symbol_id").distinct(), "symbol_id", "left_anti").unionByName(good.select(*stored.columns))


def _identity() -> list[Column]:
    return [F.coalesce(F.col(c), F.lit("")).alias(c) for c in IDENTITY]


def _last_by_identity(symbols: DataFrame, name: str) -> DataFrame:
    """One fingerprint per identity: that of the largest id."""
    mark = F.xxhash64(*[x for c in FINGERPRINT for x in (F.col(c), F.col(c).isNull())])
    rows = symbols.select(*_identity(), "id", mark.alias("mark"))
    return rows.groupBy(*IDENTITY).agg(F.max_by("mark", "id").alias(name))


def symbol_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Identities (path, kind, name, signature) that were added, removed or changed.

    Null signatures are equal. Several symbols of one identity count once, the last one decides.
    """
    both = _last_by_identity(before, "was").join(_last_by_identity(after, "is"), IDENTITY, "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return both.select(*IDENTITY, kind.alias("change")).filter("change is not null")


def symbol_change_samples(diff: DataFrame, samples: int = SYMBOL_SAMPLES) -> DataFrame:
    """Per kind of change: number of symbols and a bounded, distinct sample of names."""
    names = diff.select("change", "name").distinct()
    few = names.withColumn("n", F.row_number().over(Window.partitionBy("change").orderBy("name"))).filter(F.col("n") <= samples)
    shown = few.groupBy("change").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return diff.groupBy("change").agg(F.count("*").alias("symbols")).join(shown, "change")


def chained(events: DataFrame, flow: list[str], minutes: int = CHAIN_MINUTES) -> DataFrame:
    """Flow events with the flow event before them (same user, within the gap; null where there is none).

    Other events do not break a chain. Null users and times give no row; equal times are ordered by id.
    """
    rows = events.filter(F.col("event_type").isin(flow) & F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select("event_id", "user_id", "event_type", "ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = F.col("ts") <= F.lag("ts").over(w) + F.expr(f"interval {int(minutes)} minutes")
    return rows.withColumn("previous", F.when(near, F.lag("event_type").over(w)))


def transitions(events: DataFrame, flow: list[str], minutes: int = CHAIN_MINUTES) -> DataFrame:
    """How often each flow event follows each within the gap."""
    return chained(events, flow, minutes).filter("previous is not null").groupBy("previous", "event_type").agg(F.count("*").alias("transitions"), F.countDistinct("user_id").alias("users"))


def impact(events: DataFrame, flow: list[str], aside: list[str], minutes: int = CHAIN_MINUTES) -> DataFrame:
    """One row: flow events, chained ones, repeats, completed chains (last after another flow event), events beside the flow."""
    c = chained(events, flow, minutes)
    inside = c.agg(
        F.count("*").alias("flow_events"),
        F.count("previous").alias("chained_events"),
        F.count(F.when(F.col("previous") == F.col("event_type"), 1)).alias("repeats"),
        F.count(F.when((F.col("event_type") == flow[-1]) & (F.col("previous") != flow[-1]), 1)).alias("completed"),
    )
    beside = events.filter(F.col("event_type").isin(aside)).agg(F.count("*").alias("beside_events"))
    return inside.withColumn("one", F.lit(1)).join(beside.withColumn("one", F.lit(1)), "one").drop("one")


#: Fixed values. Commands that form chains, and the transitions that are counted: name, commands before, command now.
FLOW_COMMANDS = ["lookup", "query", "show", "graph"]
TRANSITIONS = [("lookup_to_show", ["lookup"], "show"), ("query_to_show", ["query"], "show"), ("lookup_to_graph", ["lookup"], "graph"), ("query_to_graph", ["query"], "graph")]


def command_report(events: DataFrame, minutes: int = CHAIN_MINUTES) -> DataFrame:
    """One row per project: commands, payload, seven transitions, workflow signals and the savings estimated from them.

    ``events``: event_id, project, ts, command, payload_chars, result_quality, body_mode, selected_result, no_strong_match,
    full_requested. Null projects, times and commands give no row; null facts count as not given. ``watch`` is
    infrastructure and takes no part; other commands than those of the flow do not break a chain.
    """
    rows = events.filter("project is not null and ts is not null and command is not null")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    w = Window.partitionBy("project", "in_flow").orderBy("ts", "event_id")
    before = lambda c: F.lag(c).over(w)
    near = F.col("in_flow") & (F.col("ts") <= before("ts") + F.expr(f"interval {int(minutes)} minutes"))
    rows = rows.withColumn("in_flow", F.col("command").isin(FLOW_COMMANDS)).withColumn("previous", F.when(near, before("command"))).withColumn("weak_before", F.when(near, before("no_strong_match")))
    counted = F.col("command") != "watch"
    marks = {
        "recorded_commands": counted,
        "infrastructure_commands": ~counted,
        **{name: F.col("previous").isin(first) & (F.col("command") == now) for name, first, now in TRANSITIONS},
        "full_bodies": counted & (F.col("body_mode") == "full"),
        "bodies": counted & F.col("body_mode").isNotNull(),
        "no_strong_match": counted & yes("no_strong_match"),
        "one_shot_lookups": (F.col("command") == "lookup") & (F.col("result_quality") == "strong") & yes("selected_result"),
        "good_queries": (F.col("command") == "query") & F.col("result_quality").isin("strong", "moderate"),
    }
    marks["lookup_to_full_show"] = marks["lookup_to_show"] & (F.coalesce(F.col("body_mode") == "full", F.lit(False)) | yes("full_requested"))
    marks["lookup_to_full_graph"] = marks["lookup_to_graph"] & yes("full_requested")
    marks["weak_result_retry"] = F.col("previous").isin("query", "lookup") & F.col("command").isin("query", "lookup") & yes("weak_before")
    marks["graph_follow_ups"] = marks["lookup_to_graph"] | marks["query_to_graph"]
    counts = [F.count(F.when(condition, 1)).alias(name) for name, condition in marks.items()]
    payload = F.sum(F.when(counted, F.greatest(F.coalesce("payload_chars", F.lit(0)), F.lit(0))).otherwise(0)).alias("payload_chars")
    saved = F.col("one_shot_lookups") + F.col("good_queries") + F.col("graph_follow_ups")
    out = rows.groupBy("project").agg(payload, *counts).withColumn("avoided_search_loops", saved).withColumn("avoided_file_reads", F.col("bodies"))
    return out.drop("good_queries", "bodies")


def sessions(events: DataFrame, minutes: int = CHAIN_MINUTES) -> DataFrame:
    """(user_id, session_start, session_end, events, total): runs of events without a longer gap."""
    window = F.session_window("ts", f"{int(minutes)} minutes")
    rows = events.filter("user_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = rows.groupBy("user_id", window).agg(F.count("*").alias("events"), F.max("ts").alias("last"), F.sum(F.coalesce("value", F.lit(0.0))).alias("total"))
    return grouped.select("user_id", F.col("session_window.start").alias("session_start"), F.col("last").alias("session_end"), "events", F.round("total", 4).alias("total"))


def windowed(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events and their value per type and time window."""
    rows = events.filter("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum(F.coalesce("value", F.lit(0.0))).alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))
