"""Symbols and relations extracted from the texts at hand: file heads and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomindex.plans.opened import open_index
from loomindex.queries import sqltext as q
from loomindex.queries.orphan_queries import canonical_sql
from loomindex.sources import extract, relations, tables


def _heads(spark, folder):
    h = tables.table(spark, folder, "file_heads").filter("path is not null").groupBy("path").agg(F.max("head").alias("text"))
    return open_index(spark, folder).files.select("path", "language").join(h, "path")


def _extracted(spark, folder):
    return extract.extract_symbols(_heads(spark, folder))


def extracted_symbols(spark, folder):
    return extract.with_ids(_extracted(spark, folder)).select("id", "path", "kind", "name", "signature", "extraction", "start_line", "end_line")


def extraction_counts(spark, folder):
    return _extracted(spark, folder).groupBy("language", "kind", "extraction").agg(F.count("*").alias("symbols"))


def document_headings(spark, folder):
    """Markdown headings of all documents."""
    d = tables.table(spark, folder, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.lit("markdown").alias("language"), "text")
    rows = extract.extract_symbols(d).filter("kind = 'heading'")
    return rows.select(F.col("path").cast("long").alias("doc_id"), "name", F.col("start_line").cast("long").alias("start_line"))


def yaml_keys(spark, folder):
    rows = _extracted(spark, folder).filter("kind = 'key' and not contains(name, '.')")
    return rows.select("path", "name", F.col("start_line").cast("long").alias("start_line"))


def css_selectors(spark, folder):
    return _extracted(spark, folder).filter("kind = 'selector'").groupBy("path").agg(F.count("*").alias("selectors"))


def page_titles(spark, folder):
    return _extracted(spark, folder).filter("kind = 'title'").select("path", "name")


def page_elements(spark, folder):
    return _extracted(spark, folder).filter("kind = 'element'").groupBy("path").agg(F.count("*").alias("elements"))


def fallback_rows(spark, folder):
    return _extracted(spark, folder).filter("fallback and language = 'text'").select("path", F.md5("body").alias("body_md5"))


def symbol_imports(spark, folder):
    """Import relations of all symbol bodies, resolved against the indexed files."""
    s = open_index(spark, folder).symbols.filter("kind = 'import'").select("path", "language", F.col("body").alias("text"))
    return relations.import_relations(s, open_index(spark, folder).files)


def symbol_constants(spark, folder):
    s = open_index(spark, folder).symbols.filter("language = 'ruby'").select("path", "language", F.col("body").alias("text"), relations.namespace_of(F.col("signature")).alias("namespace"))
    return relations.constant_relations(s, open_index(spark, folder).files)


def symbol_uses(spark, folder):
    """Calls in all bodies whose root is a symbol of the same file or an import."""
    s = open_index(spark, folder).symbols
    bodies = s.filter("kind not in ('import', 'file')").select("id", "path", "language", F.col("body").alias("text"))
    imports = s.filter("kind = 'import'").select("path", "language", F.col("body").alias("text"))
    return relations.use_relations(bodies, symbol_imports(spark, folder), s, relations.import_aliases(imports))


_HEADS = f"WITH {q.FILES}, h AS (SELECT path, max(head) AS text FROM file_heads WHERE path IS NOT NULL GROUP BY path), t AS (SELECT path, language, coalesce(text, '') AS text FROM fil JOIN h USING (path)), l AS (SELECT path, language, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS n FROM t)"

def _endings(base: str, endings: list[str]) -> str:
    return f"list_transform({list(endings)}, lambda e: {base} || e)"


_FOLDER = "regexp_replace(path, '/?[^/]*$', '')"


def _python_base(x: str) -> str:
    """A module as a path; leading dots go up from the importing file's folder."""
    up, rest = f"length(regexp_extract({x}, '^(\\.*)', 1))", f"replace(regexp_replace({x}, '^\\.+', ''), '.', '/')"
    inside = canonical_sql(f"({_FOLDER} || '/' || repeat('../', greatest({up} - 1, 0)::BIGINT) || '/' || {rest})")
    return f"(CASE WHEN {up} > 0 THEN {inside} ELSE {rest} END)"


_LOCAL = canonical_sql(f"({_FOLDER} || '/' || specifier)")
_IMPORTS = f"""WITH {q.SYMBOLS}, {q.FILES}, t AS (SELECT path, language, body AS text FROM sym WHERE kind = 'import' AND path IS NOT NULL AND body IS NOT NULL),
js AS (SELECT path, language, unnest(regexp_extract_all(text, '(?m)(?:^\\s*(?:import|export)\\b[^"'';]*?from\\s*|^\\s*import\\s*|\\brequire\\s*\\(\\s*|\\bimport\\s*\\(\\s*)["'']([^"''\\n]+)["'']', 1)) AS specifier FROM t WHERE language IN ('javascript', 'typescript')),
rb AS (SELECT path, language, unnest(regexp_extract_all(text, '(?m)^\\s*require_relative\\s*\\(?\\s*["'']([^"''\\n]+)["'']', 1)) AS specifier FROM t WHERE language = 'ruby'),
pl AS (SELECT path, language, unnest(string_split_regex(l, '\\s*,\\s*')) AS part FROM (SELECT path, language, unnest(regexp_extract_all(text, '(?m)^\\s*import\\s+([\\w. ,]+)$', 1)) AS l FROM t WHERE language = 'python')),
fr AS (SELECT path, language, unnest(regexp_extract_all(text, '(?m)^\\s*(from\\s+[\\w.]+\\s+import\\s+\\(?[^\\n#()]+)', 1)) AS l FROM t WHERE language = 'python'),
me AS (SELECT path, language, regexp_extract(l, '^from\\s+([\\w.]+)', 1) AS module, unnest(string_split_regex(regexp_extract(l, 'import\\s+\\(?(.*)$', 1), '\\s*,\\s*')) AS part FROM fr),
mm AS (SELECT path, language, module, regexp_extract(part, '^([\\w*]+)', 1) AS member FROM me),
sp AS (SELECT path, language, specifier, specifier AS label FROM js UNION SELECT path, language, specifier, specifier FROM rb
  UNION SELECT path, language, regexp_extract(part, '^([\\w.]+)', 1) AS s, s FROM pl WHERE s <> ''
  UNION SELECT path, language, module, CASE WHEN regexp_full_match(module, '\\.+') THEN module || member ELSE module || '.' || member END FROM mm WHERE member <> ''),
ca AS (SELECT path, label, CASE
    WHEN language IN ('javascript', 'typescript') THEN CASE WHEN NOT starts_with(specifier, '.') THEN NULL WHEN regexp_matches(specifier, '\\.[A-Za-z]+$') THEN [{_LOCAL}]
      ELSE list_concat({_endings(_LOCAL, relations.SCRIPT_ENDINGS)}, {_endings(_LOCAL + " || '/index'", relations.SCRIPT_ENDINGS)}) END
    WHEN language = 'ruby' THEN CASE WHEN ends_with(specifier, '.rb') THEN [{_LOCAL}] ELSE {_endings(_LOCAL, relations.RUBY_ENDINGS)} END
    ELSE list_concat({_endings(_python_base('label'), relations.PYTHON_ENDINGS[:1])}, {_endings(_python_base('specifier'), relations.PYTHON_ENDINGS)}) END AS c FROM sp),
ta AS (SELECT path, label, unnest(c) AS target, generate_subscripts(c, 1) AS priority FROM ca WHERE c IS NOT NULL),
hit AS (SELECT path, label, arg_min(target, priority) AS target FROM ta WHERE target IN (SELECT path FROM fil) GROUP BY ALL)"""

QUERIES = {
    f.__name__: f
    for f in (extracted_symbols, extraction_counts, document_headings, yaml_keys, css_selectors, page_titles, page_elements, fallback_rows, symbol_imports, symbol_constants, symbol_uses)
}
SQL = {
    "symbol_imports": f"{_IMPORTS} SELECT DISTINCT path AS source_path, 'imports' AS relation_kind, hit.target AS target_path, label AS target_label FROM sp LEFT JOIN hit USING (path, label)",
    "document_headings": "WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL)"
    " SELECT doc_id, regexp_extract(line, '^#{1,6}[\\s\\x{00A0}]+(.*\\S)\\s*$', 1) AS name, n AS start_line FROM l WHERE regexp_matches(line, '^#{1,6}[\\s\\x{00A0}]+(.*\\S)\\s*$')",
    "yaml_keys": f"{_HEADS} SELECT path, regexp_extract(line, '^([A-Za-z0-9_.-]+)\\s*:', 1) AS name, n AS start_line FROM l WHERE language = 'yaml' AND regexp_matches(line, '^([A-Za-z0-9_.-]+)\\s*:(\\s|$)') AND NOT contains(regexp_extract(line, '^([A-Za-z0-9_.-]+)\\s*:', 1), '.')",
    # Every block's head after the last semicolon, comments removed; at-rules are no selectors; lists are split.
    "css_selectors": f"{_HEADS}, b AS (SELECT path, unnest(regexp_extract_all(regexp_replace(text, '/\\*.*?(\\*/|\\z)', ' ', 'gs'), '([^{{}}]*)\\{{', 1)) AS head FROM t WHERE language = 'css'),"
    " m AS (SELECT path, trim(regexp_replace(head, '^.*;', '', 's'), ' ' || chr(9) || chr(10) || chr(13)) AS head FROM b), x AS (SELECT path, unnest(string_split(head, ',')) AS x FROM m WHERE NOT starts_with(head, '@'))"
    " SELECT path, count(*) AS selectors FROM x WHERE trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY 1",
    "page_titles": f"{_HEADS} SELECT path, trim(regexp_extract(text, '<title>([^<]*)</title>', 1)) AS name FROM t WHERE language = 'html' AND trim(regexp_extract(text, '<title>([^<]*)</title>', 1)) <> ''",
    "page_elements": f"{_HEADS}, e AS (SELECT path, len(regexp_extract_all(text, '<[a-zA-Z]+[^<>]*\\sid=')) AS elements FROM t WHERE language = 'html') SELECT * FROM e WHERE elements > 0",
    "fallback_rows": f"{_HEADS} SELECT path, md5(substr(text, 1, 500)) AS body_md5 FROM t WHERE language = 'text'",
}
