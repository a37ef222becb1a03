"""From a source tree to index tables, in full or for what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomindex.functions import classify
from loomindex.functions.text import embedding_text
from loomindex.operators.changes import file_diff
from loomindex.operators.graph import contained_edges
from loomindex.session import materialize
from loomindex.sources import connectors, extract, relations, tables
from loomindex.sources.tree import TreeSource
from loomindex.streaming.watch import PathTable

FILES = ["path", "language", "size", "mtime_ms"]
SYMBOLS = ["id", "path", "language", "kind", "name", "signature", "body", "doc", "fallback", "start_line", "start_column", "end_line", "end_column"]


def source_texts(spark: SparkSession, root: str, scope: str = "") -> DataFrame:
    """(path, language, size, mtime_ms, text) of the files of known language under a root.

    Files without extension are shell scripts if they look like it.
    """
    spark.dataSource.register(TreeSource)
    rows = spark.read.format("sourcetree").option("scope", scope).load(root)
    name = classify.file_name(F.col("path"))
    plain = ~name.contains(".")
    language = F.coalesce(classify.detected_language(F.col("path")), F.when(plain & classify.looks_like_shell(F.col("text")), F.lit("shell")))
    return rows.withColumn("language", language).filter("language is not null").select(*FILES, "text")


def symbols_of(texts: DataFrame) -> DataFrame:
    return extract.with_ids(extract.extract_symbols(texts)).select(*SYMBOLS)


def relations_of(texts: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """All relations of the texts; targets are looked for among ``files``."""
    columns = ["source_symbol_id", "source_path", "relation_kind", "target_path", "target_label"]
    none = F.lit(None).cast("long").alias("source_symbol_id")
    imports = relations.import_relations(texts, files)
    bodies = symbols.filter("kind not in ('import', 'file')").select("id", "path", "language", F.col("body").alias("text"))
    # Constants of a body are looked for from its namespace outwards.
    named = symbols.filter("language = 'ruby' and kind in ('class', 'module', 'method')").select("path", "language", F.col("body").alias("text"), relations.namespace_of(F.col("signature")).alias("namespace"))
    parts = [
        contained_edges(symbols).select(*columns),
        imports.select(none, *columns[1:]),
        relations.constant_relations(named.unionByName(texts.select("path", "language", "text").withColumn("namespace", F.lit(""))), files).select(none, *columns[1:]),
        relations.use_relations(bodies, imports, symbols, relations.import_aliases(texts)).select(*columns),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.distinct()
    return rows.select(F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())]).alias("id"), *columns)


def refresh(spark: SparkSession, root: str, folder: str, scope: str = "", rebuild: bool = False) -> dict[str, int]:
    """Brings the tables in ``folder`` (files, symbols, relations) up to date; returns the numbers of changes.

    Only new and changed files are extracted; rows of vanished files go. Nothing is written if nothing changed.
    The table of files is what the next refresh compares with. It is written last, so a refresh that was cut
    off is done again.
    """
    stored = {name: PathTable(spark, f"{folder}/{name}") for name in ("files", "symbols", "relations")}
    texts = materialize(source_texts(spark, root, scope), "texts")
    current = texts.select(*FILES)
    known = None if rebuild else stored["files"].read()
    diff = materialize(file_diff(current, current.limit(0) if known is None else known), "diff")
    counts = {r.change: r.n for r in diff.groupBy("change").agg(F.count("*").alias("n")).collect()}
    if not counts and known is not None:
        return counts
    touched = texts.join(diff, "path", "left_semi")
    symbols = materialize(symbols_of(touched), "symbols")
    edges = relations_of(touched, symbols, current).withColumn("path", F.col("source_path"))
    for name, rows in (("symbols", symbols), ("relations", edges), ("files", current)):
        if known is None:
            stored[name].write(rows)
        else:
            stored[name].replace(rows, diff)
    return counts


def refresh_vectors(spark: SparkSession, folder: str, service: str, model: str) -> dict[str, int]:
    """Vectors of the service's model for the symbols in ``folder`` that have none, or that have another text than when it was made; returns counts.

    Symbols that are no longer there lose theirs; vectors of other models stay. Doing it again does what is left.
    """
    symbols, stored = PathTable(spark, f"{folder}/symbols").read(), PathTable(spark, f"{folder}/embeddings")
    text = embedding_text(*[F.col(c) for c in ("path", "kind", "name", "signature", "doc", "body")])
    wanted = symbols.select("id", "path", text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    known = stored.read()
    if known is None:
        known = spark.createDataFrame([], f"path string, text_hash bigint, {tables.EMBEDDINGS}")
    mine = known.filter((F.col("model") == model) & (F.col("provider") == service))
    missing = materialize(wanted.join(mine.select(F.col("symbol_id").alias("id"), "text_hash"), ["id", "text_hash"], "left_anti"), "missing")
    gone = mine.join(wanted.select(F.col("id").alias("symbol_id"), "text_hash"), ["symbol_id", "text_hash"], "left_anti")
    touched = materialize(missing.select("path").union(gone.select("path")).distinct().withColumn("change", F.lit("changed")), "touched")
    counts = {"made": missing.count(), "dropped": gone.count()}
    if any(counts.values()):
        made = connectors.embed_texts(missing, service, model).join(missing.select(F.col("id").alias("symbol_id"), "path", "text_hash"), "symbol_id")
        kept = known.join(gone.select("symbol_id", "text_hash", "provider", "model"), ["symbol_id", "text_hash", "provider", "model"], "left_anti").join(touched.select("path"), "path", "left_semi")
        columns = ["path", "text_hash", *tables.column_names(tables.EMBEDDINGS)]
        stored.replace(kept.select(*columns).unionByName(made.select(*columns)), touched)
    return counts


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that ``refresh`` and ``refresh_vectors`` keep; ``embeddings`` is None before the latter."""
    found = {name: PathTable(spark, f"{folder}/{name}").read() for name in ("files", "symbols", "relations", "embeddings")}
    return found | {"relations": found["relations"].drop("path")}
