"""Pieces of SQL that several queries' reference statements share (DuckDB dialect)."""

from __future__ import annotations

from loomindex.functions import classify
from loomindex.functions.text import STOPWORDS

SYMBOLS = (
    "sym AS (SELECT id, min(path) path, min(language) AS language, min(kind) kind, min(name) AS name, min(signature) signature, min(body) body, min(doc) doc, bool_or(fallback) fallback,"
    " min(start_line) start_line, min(start_column) start_column, min(end_line) end_line, min(end_column) end_column FROM symbols WHERE id IS NOT NULL GROUP BY id)"
)
FILES = "fil AS (SELECT path, arg_max(language, (mtime_ms, coalesce(size, -1))) AS language, arg_max(size, (mtime_ms, coalesce(size, -1))) AS size, max(mtime_ms) mtime_ms FROM files WHERE path IS NOT NULL GROUP BY path)"
RELATIONS = (
    "rel AS (SELECT id, min(source_symbol_id) source_symbol_id, min(source_path) source_path, min(relation_kind) relation_kind, min(target_path) target_path, min(target_label) target_label"
    " FROM relations WHERE id IS NOT NULL GROUP BY id)"
)


def quoted(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def key(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


def stored_key(x: str) -> str:
    return f"replace(replace(replace(replace(replace(replace(lower({x}), chr(92), ''), '/', ''), '-', ''), ' ', ''), '.', ''), ':', '')"


def terms(x: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda t: t <> '')"


def name_parts(x: str) -> str:
    inner = f"regexp_replace(regexp_replace(coalesce({x}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return terms(inner)


def stem(x: str) -> str:
    return (
        f"CASE WHEN {x} LIKE '%ies' AND length({x}) > 4 THEN substr({x}, 1, length({x}) - 3) || 'y' WHEN {x} LIKE '%ing' AND length({x}) > 5 THEN substr({x}, 1, length({x}) - 3)"
        f" WHEN {x} LIKE '%s' AND {x} NOT LIKE '%ss' AND length({x}) > 3 THEN substr({x}, 1, length({x}) - 1) ELSE {x} END"
    )


def folded(x: str) -> str:
    return f"replace(lower({x}), '\\', '/')"


def is_test(x: str) -> str:
    return f"({folded(x)} LIKE 'tests/%' OR {folded(x)} LIKE '%/test%')"


def in_folder(x: str, folder: str) -> str:
    return f"({folded(x)} LIKE '{folder}/%' OR {folded(x)} LIKE '%/{folder}/%')"


def is_front(path: str, language: str) -> str:
    return f"({language} IN {quoted(classify.FRONT_LANGUAGES)} AND (" + " OR ".join(in_folder(path, f) for f in classify.FRONT_FOLDERS) + "))"


def is_operational(path: str) -> str:
    return f"({folded(path)} IN ('agents.md', 'claude.md') OR " + " OR ".join(f"{folded(path)} LIKE '{s}%'" for s in classify.STATE_FOLDERS) + ")"


def is_definition(kind: str) -> str:
    return f"({kind} IN {quoted(classify.DEFINITIONS)})"


def file_name(path: str) -> str:
    return f"string_split({folded(path)}, '/')[-1]"


def snippet(x: str) -> str:
    flat = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({flat}) <= 200 THEN {flat} ELSE rtrim(substr({flat}, 1, 197)) || '...' END"


def extraction(fallback: str, doc: str) -> str:
    return f"CASE WHEN coalesce({fallback}, false) THEN 'fallback' WHEN coalesce({doc}, '') LIKE '{classify.RECOVERED_MARK}%' THEN 'recovered' ELSE 'parsed' END"


def first_true(conditions: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN coalesce({c}, false) THEN {i}" for i, c in enumerate(conditions)) + f" ELSE {len(conditions)} END"


def kind_order(kinds: list[str]) -> str:
    return first_true([f"kind = '{k}'" for k in kinds])


def root_reasons(path: str, language: str, names: str) -> str:
    """A list of up to three reasons; ``names`` is a list expression of lower-case names."""
    name = file_name(path)
    rules = [
        (f"{name} = '__main__.py'", "python __main__ entrypoint"),
        (f"{name} IN {quoted(classify.ENTRY_NAMES)}", "common startup or entrypoint filename"),
        (f"{language} = 'shell' AND regexp_replace({name}, '\\.[^.]+$', '') IN {quoted(classify.ENTRY_SCRIPTS)}", "shell startup script name"),
        (f"{in_folder(path, 'bin')} OR {in_folder(path, 'scripts')}", "script or bin path"),
        (f"{language} = 'css' AND ({in_folder(path, 'static/css')} OR {in_folder(path, 'styles')} OR {folded(path)} LIKE '%/assets/css/%')", "frontend stylesheet path"),
        (f"{language} IN ('javascript', 'typescript') AND ({' OR '.join(in_folder(path, f) for f in ('dashboard_frontend', 'frontend', 'web'))})", "frontend application path"),
        (f"list_contains({names}, 'main')", "top-level main symbol"),
        (f"list_has_any({names}, ['cli', 'run', 'startup'])", "top-level entry symbol"),
    ]
    items = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for c, r in rules)
    return f"list_slice(list_filter([{items}], lambda r: r IS NOT NULL), 1, 3)"


STOP = quoted(STOPWORDS)
