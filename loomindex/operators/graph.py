"""Joins over the relation graph: neighbourhoods, neighbours, containers, diagnostics, roots, orphans.

Everything is one hop. Batch forms answer for all symbols at once (no statement per symbol); disjunctive
conditions are unions of equi-joins; top-k per key is a window that Spark limits before its shuffle.
Counts per path are aggregated before they meet the symbols, so a path that a third of all relations
point to is one row by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomindex.functions import classify
from loomindex.operators.candidates import first_true, kind_order

REFERENCES = ["imports", "uses"]
NEIGHBOUR_KINDS = ["class", "function", "title", "element"]
PATH_COUNTS = ["outgoing_imports", "incoming_imports", "outgoing_uses", "incoming_uses"]


def contained_edges(symbols: DataFrame) -> DataFrame:
    """Each symbol's edge to the file that it is in."""
    s = symbols.filter("kind <> 'file'")
    return s.select(F.col("id").alias("source_symbol_id"), F.col("path").alias("source_path"), F.lit("contained_in").alias("relation_kind"), F.col("path").alias("target_path"), F.col("path").alias("target_label"))


def neighbourhood(relations: DataFrame, candidates: DataFrame) -> DataFrame:
    """Distinct import and use edges whose two ends are both paths of the candidates."""
    paths = candidates.select("path").distinct()
    edges = relations.filter(F.col("relation_kind").isin(REFERENCES) & F.col("target_path").isNotNull()).select("relation_kind", "source_path", "target_path")
    inside = edges.join(paths.withColumnRenamed("path", "source_path"), "source_path", "left_semi").join(paths.withColumnRenamed("path", "target_path"), "target_path", "left_semi")
    return inside.select("relation_kind", "source_path", "target_path").distinct()


def edge_counts(edges: DataFrame) -> DataFrame:
    """Per path: distinct neighbours by direction and kind."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("source_path").alias("path"), F.concat(F.lit("outgoing_"), F.col("relation_kind")).alias("what")),
                F.struct(F.col("target_path").alias("path"), F.concat(F.lit("incoming_"), F.col("relation_kind")).alias("what")),
            )
        ).alias("end")
    ).select("end.*")
    return ends.groupBy("path").agg(*[F.count(F.when(F.col("what") == c, 1)).alias(c) for c in PATH_COUNTS])


def graph_support(candidates: DataFrame, relations: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(id, graph_score, signals) of code candidates that the other candidates support.

    ``candidates``: id, path, kind, language. Fewer than two code candidates have no support.
    """
    code = candidates.filter("language <> 'markdown'").select("id", "path", "kind")
    same = code.groupBy("path").agg(F.count("*").alias("same"))
    enough = code.limit(2).count() >= 2
    counts = edge_counts(neighbourhood(relations, code))
    rows = code.join(same, "path").join(counts, "path", "left").filter(F.lit(enough))
    if roots is not None:
        rows = rows.join(roots.select("path").distinct().withColumn("root", F.lit(True)), "path", "left")
    else:
        rows = rows.withColumn("root", F.lit(False))
    definition = classify.is_definition(F.col("kind"))
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in PATH_COUNTS}
    root = F.coalesce("root", F.lit(False))
    #: Weight, number and cut-off of each kind of support.
    parts = [
        ("same_file_cluster", F.lit(0.22), F.col("same") - 1, 3),
        ("imports_candidate", F.lit(0.38), n["outgoing_imports"], 2),
        ("imported_by_candidate", F.when(definition, 0.95).otherwise(0.5), n["incoming_imports"], 2),
        ("uses_candidate", F.lit(0.22), n["outgoing_uses"], 2),
        ("used_by_candidate", F.when(definition, 0.7).otherwise(0.35), n["incoming_uses"], 2),
        ("root_candidate", F.when(definition, 0.45).otherwise(0.2), root.cast("int"), 1),
    ]
    score = F.lit(0.0)
    for _, weight, count, most in parts:
        score = score - weight * F.least(count, F.lit(most))
    signals = F.array_compact(F.array(*[F.when(count > 0, F.lit(name)) for name, _, count, _ in parts]))
    damped = F.when(F.col("kind") == "import", score * 0.35).otherwise(score)
    return rows.select("id", damped.alias("graph_score"), signals.alias("signals")).filter(F.size("signals") > 0)


def relations_of(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct (id, relation_kind, target_path, target_label): a symbol's own edges and its file's imports."""
    edge = ["relation_kind", "target_path", "target_label"]
    own = relations.filter("source_symbol_id is not null").select(F.col("source_symbol_id").alias("id"), *edge).join(symbols.select("id"), "id", "left_semi")
    imports = relations.filter("relation_kind = 'imports'").select(F.col("source_path").alias("path"), *edge).distinct()
    of_file = symbols.select("id", "path").join(imports, "path").select("id", *edge)
    return own.union(of_file).distinct()


def inbound_of(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct (path, relation_kind, source_path, target_label) of edges into the symbols' files."""
    edges = relations.filter(F.col("relation_kind").isin(REFERENCES)).select(F.col("target_path").alias("path"), "relation_kind", "source_path", "target_label")
    return edges.join(symbols.select("path").distinct(), "path", "left_semi").distinct()


def label_tail(label: Column) -> Column:
    return F.trim(F.element_at(F.split(label, r"::|\."), -1))


def neighbours_in(edges: DataFrame, symbols: DataFrame, path: str, inbound: bool, k: int = 5) -> DataFrame:
    """(path, target_label, neighbour_id, place): for each distinct file and label of the edges, the k symbols that fit best.

    Outbound edges look at names only; inbound edges also at signatures and bodies that mention the label.
    Edges are reduced to distinct files and labels first, however many relations share them.
    """
    key = [path, "target_label"]
    wanted = F.lower(label_tail(F.col("target_label")))
    tests = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(wanted) for c in (("signature", "body") if inbound else ("name",))]
    there = symbols.filter(~F.col("kind").isin("import", "file")).select(F.col("path").alias(path), F.col("id").alias("neighbour_id"), "name", "kind", "signature", "body", "start_line")
    joined = edges.select(*key).filter(F.col(path).isNotNull()).distinct().join(there, path)
    placed = joined.select(*key, "neighbour_id", "start_line", first_true([F.lower("name") == wanted, *tests]).alias("level"), kind_order(NEIGHBOUR_KINDS).alias("kind_place"))
    order = Window.partitionBy(*key).orderBy("level", "kind_place", "start_line", "neighbour_id")
    return placed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select(*key, "neighbour_id", "place")


def containers(symbols: DataFrame, of: DataFrame | None = None, k: int = 3) -> DataFrame:
    """(id, container_id, place): the k tightest symbols of the same file whose span encloses a symbol's.

    A span of up to ``2**level`` lines lies in one or two blocks of that many lines. It is looked for in the
    block of the inner symbol's first line, so only spans near a symbol meet it, however large its file.
    """
    span = ["start_line", "start_column", "end_line", "end_column"]
    inner = (symbols if of is None else of).select("id", "path", *span)
    outer = symbols.filter(~F.col("kind").isin("import", "file")).select(F.col("id").alias("container_id"), "path", *[F.col(c).alias(f"c_{c}") for c in span])
    outer = outer.withColumn("level", F.ceil(F.log2(F.greatest(F.col("c_end_line") - F.col("c_start_line") + 1, F.lit(1)))).cast("int")).filter("level is not null")
    levels = [r.level for r in outer.select("level").distinct().collect()]  # at most 31 numbers
    block = lambda line, level: F.floor(F.col(line) / F.pow(F.lit(2.0), level)).cast("long")
    first, last = block("c_start_line", F.col("level")), block("c_end_line", F.col("level"))
    outer = outer.withColumn("block", F.explode(F.when(last > first, F.array(first, last)).otherwise(F.array(first))))
    inner = inner.filter("start_line is not null").withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("block", block("start_line", F.col("level")))
    before = (F.col("c_start_line") < F.col("start_line")) | ((F.col("c_start_line") == F.col("start_line")) & (F.col("c_start_column") <= F.col("start_column")))
    after = (F.col("c_end_line") > F.col("end_line")) | ((F.col("c_end_line") == F.col("end_line")) & (F.col("c_end_column") >= F.col("end_column")))
    size = (F.col("c_end_line") - F.col("c_start_line")) * 1000 + (F.col("c_end_column") - F.col("c_start_column"))
    order = Window.partitionBy("id").orderBy(size, "c_start_line", "container_id")
    found = inner.join(outer, ["path", "level", "block"]).filter((F.col("id") != F.col("container_id")) & before & after)
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("id", "container_id", "place")


def _outward(symbols: DataFrame, relations: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges of the chosen symbols with the two best neighbours (the second stands in for the symbol itself)."""
    own = relations_of(chosen, relations)
    edges = own.filter("relation_kind <> 'contained_in' and target_path is not null")
    targets = edges.join(neighbours_in(edges, symbols, "target_path", False, 2), ["target_path", "target_label"])
    around = own.filter("relation_kind = 'contained_in'").join(containers(symbols, chosen, 1), "id")
    columns = ["id", F.col("relation_kind").alias("traversal"), F.col("target_path").alias("other_path"), "target_label"]
    return targets.select(*columns, "neighbour_id", "place").union(around.select(*columns, F.col("container_id").alias("neighbour_id"), "place"))


def _inward(symbols: DataFrame, relations: DataFrame, chosen: DataFrame, limit: int) -> DataFrame:
    """Edges into the chosen symbols' files with their best neighbours.

    From other files only the first ``limit`` neighbours of a file can be shown, so no more are kept: a
    file that a third of all relations point to does not multiply with its symbols.
    """
    edges = inbound_of(chosen, relations)
    found = edges.join(neighbours_in(edges, symbols, "source_path", True, 2), ["source_path", "target_label"])
    back = F.when(F.col("relation_kind") == "imports", "imported_by").otherwise("used_by")
    rows = found.select("path", back.alias("traversal"), F.col("source_path").alias("other_path"), "target_label", "neighbour_id", "place")
    inside = F.col("other_path") == F.col("path")
    order = [F.asc_nulls_first("target_label"), F.asc_nulls_first("other_path"), "neighbour_id"]
    first = rows.filter(~inside & (F.col("place") == 1)).withColumn("n", F.row_number().over(Window.partitionBy("path", "traversal", "neighbour_id").orderBy(*order))).filter("n = 1")
    few = first.withColumn("n", F.row_number().over(Window.partitionBy("path", "traversal").orderBy(*order))).filter(F.col("n") <= limit).drop("n")
    kept = few.union(rows.filter(inside))
    return chosen.select("id", "path").join(kept, "path").select("id", "traversal", "other_path", "target_label", "neighbour_id", "place")


def traversal(symbols: DataFrame, relations: DataFrame, chosen: DataFrame, limit: int = 5, inbound: bool = True) -> DataFrame:
    """(id, traversal, neighbour_id, target_label, place) one hop from each chosen symbol.

    Outbound edges come before inbound ones; each edge gives its best neighbour that is not the symbol
    itself, and a neighbour counts once per kind of traversal.
    """
    rows = _outward(symbols, relations, chosen).withColumn("side", F.lit(0))
    if inbound:
        rows = rows.union(_inward(symbols, relations, chosen, limit).withColumn("side", F.lit(1)))
    rows = rows.filter("neighbour_id <> id")
    edge = ["id", "side", "traversal", "other_path", "target_label"]
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy(*edge).orderBy("place"))).filter("n = 1").drop("n")
    order = ["side", "traversal", F.asc_nulls_first("target_label"), F.asc_nulls_first("other_path"), "neighbour_id"]
    once = best.withColumn("n", F.row_number().over(Window.partitionBy("id", "traversal", "neighbour_id").orderBy(*order))).filter("n = 1").drop("n")
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
    return placed.filter(F.col("place") <= limit).select("id", "traversal", "neighbour_id", "target_label", "place")


def traversal_groups(found: DataFrame) -> DataFrame:
    """One row per symbol with a list of neighbours per kind of traversal; at most ``limit`` entries in all."""
    lists = [
        F.transform(F.array_sort(F.collect_list(F.when(F.col("traversal") == t, F.struct("place", "neighbour_id")))), lambda x: x["neighbour_id"]).alias(t)
        for t in ("imports", "uses", "contained_in", "imported_by", "used_by")
    ]
    return found.groupBy("id").agg(*lists)


def _outbound(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, path, target_path): references of symbols and imports of their files, with repeats."""
    there = relations.filter(F.col("target_path").isNotNull())
    own = there.filter(F.col("source_symbol_id").isNotNull() & F.col("relation_kind").isin(REFERENCES)).select(F.col("source_symbol_id").alias("id"), F.col("source_path").alias("path"), "target_path")
    imports = there.filter("relation_kind = 'imports'").select(F.col("source_path").alias("path"), "target_path").distinct()
    return own.union(symbols.select("id", "path").join(imports, "path").select("id", "path", "target_path"))


def inbound_counts(relations: DataFrame) -> DataFrame:
    """Per target path: distinct sources, those in other files, those that are tests."""
    edges = relations.filter(F.col("relation_kind").isin(REFERENCES) & F.col("target_path").isNotNull()).select(F.col("target_path").alias("path"), "source_path").distinct()
    other = F.col("source_path") != F.col("path")
    return edges.groupBy("path").agg(
        F.count("source_path").alias("inbound"), F.count(F.when(other, 1)).alias("inbound_other"), F.count(F.when(classify.is_test_path(F.col("source_path")), 1)).alias("inbound_tests")
    )


def outbound_counts(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Per symbol: distinct targets and those in other files."""
    edges = _outbound(symbols, relations).distinct()
    return edges.groupBy("id").agg(F.countDistinct("target_path").alias("outbound"), F.countDistinct(F.when(F.col("target_path") != F.col("path"), F.col("target_path"))).alias("outbound_other"))


def diagnostics(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """How each symbol is connected. Inbound counts are those of its file, shared by its symbols."""
    rows = (
        symbols.select("id", "path", "language", "kind", "name")
        .join(inbound_counts(relations), "path", "left")
        .join(outbound_counts(symbols, relations), "id", "left")
        .fillna(0, ["inbound", "inbound_other", "inbound_tests", "outbound", "outbound_other"])
    )
    roots = classify.root_reasons(F.col("path"), F.col("language"), F.array("name"))
    inbound, outbound = F.col("inbound"), F.col("outbound")
    same_only = (inbound + outbound > 0) & (F.col("inbound_other") + F.col("outbound_other") == 0)
    root = F.size("root_reasons") > 0
    apart = (inbound == 0) & (outbound == 0) & ~root
    orphan = (inbound == 0) & ~root & ~F.col("same_file_only")
    reasons = [(F.lit(True), "no known inbound references"), (F.lit(True), "not classified as a likely root"), (F.col("disconnected"), "disconnected from the indexed graph")]
    notes = [
        (inbound == 0, "no known inbound references"),
        (F.col("tests_only"), "inbound references only from tests"),
        (F.col("same_file_only"), "connected only within its file"),
        (F.col("disconnected"), "neither inbound nor outbound references"),
        (F.col("root_like"), "looks like an entry point"),
    ]
    texts = lambda rules: F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))
    return (
        rows.withColumn("root_reasons", roots)
        .withColumn("tests_only", (inbound > 0) & (F.col("inbound_tests") == inbound))
        .withColumn("same_file_only", same_only)
        .withColumn("root_like", root)
        .withColumn("disconnected", apart)
        .withColumn("possible_orphan", orphan)
        .withColumn("orphan_reasons", F.when(F.col("possible_orphan"), texts(reasons)).otherwise(F.array().cast("array<string>")))
        .withColumn("notes", texts(notes))
    )


def likely_roots(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files with reasons to be an entry point: (path, language, reasons).

    Only the few names that matter are kept per file, so no list grows with a file's symbols.
    """
    telling = ["main", "cli", "run", "startup"]
    top = symbols.filter(~F.col("kind").isin("import", "file") & (F.col("start_line") <= 160)).select("path", F.lower("name").alias("name")).filter(F.col("name").isin(telling))
    names = top.groupBy("path").agg(F.collect_set("name").alias("names"))
    rows = files.select("path", "language").join(names, "path", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    return rows.select("path", "language", classify.root_reasons(F.col("path"), F.col("language"), F.col("names")).alias("reasons")).filter(F.size("reasons") > 0)


def top_roots(files: DataFrame, symbols: DataFrame, limit: int = 12) -> DataFrame:
    return likely_roots(files, symbols).orderBy(F.desc(F.size("reasons")), "path").limit(limit)


def possible_orphans(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Definitions outside tests and documents that nothing refers to: (id, path, language, kind, name, outbound)."""
    rows = diagnostics(symbols, relations).join(symbols.select("id", "fallback"), "id")
    code = ~F.coalesce("fallback", F.lit(False)) & (F.col("language") != "markdown") & ~classify.is_test_path(F.col("path")) & classify.is_definition(F.col("kind"))
    return rows.filter(code & F.col("possible_orphan")).select("id", "path", "language", "kind", "name", "outbound")
